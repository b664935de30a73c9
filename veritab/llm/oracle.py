"""SQL for the operators that SQL can express, in DuckDB's dialect."""

from veritab.llm import decontamination as D
from veritab.llm import hard_negatives as H
from veritab.llm import manifest as M
from veritab.llm import quality_rules as Q

_SPACE = r"[\x20\x09-\x0D]"
_ONLY = lambda chars: f"length(regexp_replace(t, '[^{chars}]+', '', 'g'))"
_QUOTED = {k: v.replace("'", "''") for k, v in Q.CLASSES.items()}


def _distance(shares: str, refs: str) -> str:
    """The Jensen-Shannon distance of a list of counts to the nearest of a list of lists of shares."""
    total = f"list_sum({shares})"
    part = f"(({shares})[i] / {total})"
    half = f"(({part} + r[i]) / 2)"
    term = f"case when {part} > 0 then {part} * log2({part} / {half}) else 0 end + case when r[i] > 0 then r[i] * log2(r[i] / {half}) else 0 end"
    return f"case when {total} > 0 then sqrt(greatest(0.0, list_min(list_transform({refs}, lambda r: list_sum(list_transform(range(1, len(r) + 1), lambda i: {term}))) ) / 2)) end"


def quality_rules() -> str:
    """Common words, references and limits are worked out from the tables, as the operator does."""
    classes = ", ".join(f"{_ONLY(v)} as c_{k}" for k, v in _QUOTED.items())
    names = [f"c_{k}" for k in Q.CLASSES]
    n_chars = len(Q.CLASSES) + 2
    shares = "[" + ", ".join(f"sum(cc[{k}]) / sum(list_sum(cc))" for k in range(1, n_chars + 1)) + "]"
    failed = f"(n_words < {Q.MIN_WORDS} or 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words)"
    k = Q.WINDOW
    word_chars = "coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)"
    half = "((1 + other) / 2)"
    return f"""
with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from documents),
s as (select *, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls, length(t) as n_chars, {classes} from d),
u as (select lang, w, count(*) as n from (select lang, unnest(w) as w from s where lang is not null) x where length(w) <= {Q.COMMON_LETTERS} group by lang, w),
common as (select distinct w from (select w, row_number() over (partition by lang order by n desc, w) as k from u) x where k <= {Q.COMMON_WORDS}),
names as (select coalesce(list(w order by w), []) as names from common),
g as (select rid, i, array_to_string(w[i:i + {k - 1}], ' ') as g from (select rid, w, unnest(range(1, len(w) - {k - 2})) as i from s where len(w) >= {k}) x),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from g) y where n > 1),
p as (select rid, sum(least({k}, nxt - i))::bigint as n_repeat_words from (select rid, i, coalesce(lead(i) over (partition by rid order by i), i + {k}) as nxt from r) z group by rid),
h as (select rid, w, count(*) as n from (select rid, unnest(w) as w from s) x where w in (select w from common) group by rid, w),
v as (select rid, map_from_entries(list((w, n))) as found, sum(n) as n_found from h group by rid),
c as (select s.rid, doc_id, lang, len(w) as n_words, n_chars, {word_chars}::bigint as word_chars, c_symbol as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(p.n_repeat_words, 0) as n_repeat_words,
    [{", ".join(names)}, n_chars - {word_chars}, {word_chars} - ({" + ".join(names)})] as cc,
    list_append(list_transform(names, lambda x: coalesce(found[x], 0)), len(w) - coalesce(n_found, 0)) as wc from s left join p on s.rid = p.rid left join v on s.rid = v.rid, names),
ok as (select * from c where not {failed} and lang is not null),
fc as (select lang, {shares} as rc from ok group by lang),
each as (select lang, i, sum(wc[i]) as n from (select lang, wc, unnest(range(1, len(wc) + 1)) as i from ok) x group by lang, i),
fw as (select lang, list(n / total order by i) as rw, list(n / total order by i)[-1] as other from (select *, sum(n) over (partition by lang) as total from each) x group by lang),
q as (select (select list(rc) from fc) as rc, (select list(rw) from fw where pow(other, {Q.GUARD_WORDS}) <= {Q.LACKS_ALL}) as rw,
    (select min(sqrt((1 - log2({half}) + case when other > 0 then other * log2(other / {half}) else 0 end - other) / 2)) from fw where pow(other, {Q.GUARD_WORDS}) <= {Q.LACKS_ALL}) as bare,
    coalesce((select list(lang) from fw where pow(other, {Q.GUARD_WORDS}) > {Q.LACKS_ALL}), []) as others),
x as (select c.*, {failed} as base_failed, {_distance("cc", "rc")} as js_chars, {_distance("wc", "rw")} as js_words, bare, others from c, q)
select doc_id, n_words::bigint as n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words, base_failed,
    not base_failed and not coalesce(n_chars >= {Q.GUARD_CHARS} and js_chars > {Q.MAX_CHAR_DISTANCE}, false)
    and not coalesce(n_words >= {Q.GUARD_WORDS} and js_words >= {Q.BARE_SHARE} * bare and (len(others) = 0 or not coalesce(list_contains(others, lang), true)), false) as kept from x"""


def warc() -> str:
    """Base 32 is written from five hexadecimal digits, that is four letters, at a time."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = "cast(concat('0x', substr(h, 5 * k + 1, 5)) as integer)"
    part = " || ".join(f"substr('{letters}', 1 + (({five} >> {s}) & 31), 1)" for s in (15, 10, 5, 0))
    return f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages), f as (select h, min(page_id) as f from p group by h)
select page_id, octet_length(encode(html))::bigint as payload_bytes, array_to_string(list_transform(range(0, 8), lambda k: {part}), '') as payload_digest,
    case when page_id = f then 'response' else 'revisit' end as record_type, case when page_id <> f then f end as refers_to from p join f using (h)"""


def decontamination() -> str:
    """Windows are compared as texts: of each number of words that an item's windows have."""
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{M.UPPER}', '{M.UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    n = D.WINDOW
    return f"""
with d as (select row_number() over () as rid, doc_id, {words("text")} as w from documents),
b as (select item_id, w, least({n}, len(w)) as k from (select item_id, {words("text")} as w from benchmark) x where len(w) > 0),
v as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as g from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from b) x),
g as (select rid, k, i, array_to_string(w[i:i + k - 1], ' ') as g from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from b) ks where len(w) >= k) x),
h as (select g.rid, g.i, g.k, v.item_id from g join v on g.k = v.k and g.g = v.g),
s as (select rid, i, max(k) as k from h group by rid, i),
p as (select rid, count(*) as n_hit from (select distinct rid, unnest(range(i, i + k)) as at from s) x group by rid),
t as (select rid, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as listed from (select distinct rid, item_id from h where item_id is not null) x group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p on d.rid = p.rid left join t on d.rid = t.rid"""


def _crc(c: str) -> str:
    """CRC-32 of a number's decimal text, bit by bit."""
    codes = f"list_transform(string_split({c}::varchar, ''), lambda ch: ascii(ch)::bigint)"
    bits = "list_reduce(list_prepend(xor(crc, code), [0::bigint for i in range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"case when {c} is not null then xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {codes}), lambda crc, code: {bits})) end"


def manifest(levels: int = 8) -> str:
    """Trees of up to FAN ** levels documents a language, and as many languages; a tree with one node left is carried on as it is."""
    field = lambda c: f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(concat(" + ", ".join(field(c) for c in M.FIELDS[:-1]) + f", {field(text)}))"
    parts = [
        "d as (select row_number() over () as rid, * from documents)",
        f"""x0 as (select rid, doc_id, lang, {leaf("text")} as h, case when coalesce(({_crc("doc_id")}) % 3 = 0, false) then {leaf(f"translate(text, '{M.UPPER}', '{M.UPPER.lower()}')")} end as altered from d)""",
        "r as (select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as pos, dense_rank() over (order by encode(lang) nulls first) - 1 as tree from x0)",
        "n0 as (select tree, pos, h from r)",
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            parts.append(f"{name}g{k} as (select tree, pos // {M.FAN} as run, string_agg(h, '' order by pos) as g, count(*) as c, any_value(size) as size from (select *, count(*) over (partition by tree) as size from {name}{k}) y group by tree, run)")
            parts.append(f"{name}{k + 1} as (select tree, run as pos, case when size = 1 then g else sha256(g) end as h from {name}g{k})")

    def path(name: str, rows: str) -> str:
        for k in range(levels):
            at = f"(x.pos // {M.FAN**k})"
            rows = f"""(select x.* exclude (p, f), case when g.size = 1 then p else p || substr(g.g, 1, 64 * ({at} % {M.FAN})) || substr(g.g, 64 * ({at} % {M.FAN}) + 65) end as p,
                case when g.size = 1 then f else sha256(substr(g.g, 1, 64 * ({at} % {M.FAN})) || f || substr(g.g, 64 * ({at} % {M.FAN}) + 65)) end as f
                from {rows} x join {name}g{k} g on g.tree = x.tree and g.run = {at} // {M.FAN})"""
        return rows

    climb("n")
    parts.append(f"m0 as (select 0 as tree, tree as pos, h from n{levels})")
    climb("m")
    parts.append(f"inner_path as (select * from {path('n', '(select r.*, h as leaf, coalesce(altered, h) as f, $$$$ as p from r)')} z)".replace("$$$$", "''"))
    parts.append(f"outer_path as (select * from {path('m', '(select doc_id, leaf, p, f, tree as pos, 0 as tree, tree as own from inner_path)')} z)")
    return f"""with {", ".join(parts)}
select doc_id, leaf, s.h as subroot, t.h as root, sha256(p) as proof_sha256, f as folded_root, f = t.h as verified from outer_path o join n{levels} s on s.tree = o.own, m{levels} t"""


def hard_negatives() -> str:
    return f"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select * from (select *, row_number() over (partition by a order by score desc, b) as k from s where same) x where k <= {H.POSITIVES}),
n as (select p.a, p.b as positive_id, p.score as positive_score, s.b as negative_id, s.score as negative_score, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as rank
    from p join s on p.a = s.a where not s.same and {H.LOW} * p.score <= 100 * s.score and 100 * s.score <= {H.HIGH} * p.score)
select a as anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= {H.NEGATIVES}"""
