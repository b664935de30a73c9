"""A function called in child processes, with a deadline and a memory limit for each call.

Each task keeps a child and sends it one argument after another. A child that doesn't answer in time is killed; one that ends
or runs out of memory is replaced. Either way the call has an error as its result, and the next one goes on in a new child.
The function is pickled by value where it can't be imported, so lambdas and closures may be given.
"""

from __future__ import annotations

import os
import pickle
import selectors
import struct
import subprocess
import sys
import time
from collections.abc import Callable

from veritab.functions.workers import ROOT

#: How long a document may take, and how much memory its reader may have.
DEADLINE = 90.0
MEMORY = 2 << 30
#: Seconds that a new child has to start and load the function.
START = 60.0
HEADER = struct.Struct("<Q")

#: What a child runs: its answers go to a copy of its standard output, so that whatever the function prints can't be taken for one.
_CHILD = "import sys; sys.path[:0] = [p for p in sys.argv[2:] if p not in sys.path]; from veritab.sources import isolated; isolated.serve(int(sys.argv[1]))"


def serve(memory: int) -> None:
    """A child's side: load the function, then answer each argument until there are no more."""
    import resource

    answers = os.fdopen(os.dup(1), "wb")
    os.dup2(2, 1)
    asked = sys.stdin.buffer
    resource.setrlimit(resource.RLIMIT_AS, (memory, memory))

    def send(kind: str, value) -> None:
        data = pickle.dumps((kind, value))
        answers.write(HEADER.pack(len(data)) + data)
        answers.flush()

    f = pickle.loads(_received(asked))
    send("ready", None)
    while data := _received(asked):
        try:
            send("value", f(pickle.loads(data)))
        except MemoryError:
            send("error", "out of memory")
            return  # what is left of the memory is of no use
        except Exception as error:  # noqa: BLE001 (whatever a reader raises is a result)
            send("error", f"{type(error).__name__}: {error}" if not isinstance(error, ValueError) else str(error))


def _received(stream) -> bytes:
    head = stream.read(HEADER.size)
    return stream.read(HEADER.unpack(head)[0]) if len(head) == HEADER.size else b""


class CallError(RuntimeError):
    """What a call came to instead of a value."""


class Isolated:
    """f, called in a child process of this one. Use it as a context: at its end the child is gone."""

    def __init__(self, f: Callable | bytes, deadline: float = DEADLINE, memory: int = MEMORY):
        from pyspark import cloudpickle

        self.function = f if isinstance(f, bytes) else cloudpickle.dumps(f)
        self.deadline, self.memory, self.child = deadline, memory, None

    def __enter__(self) -> Isolated:
        return self

    def __exit__(self, *_) -> None:
        self._end()

    def _end(self) -> int | None:
        child, self.child = self.child, None
        if child is None:
            return None
        child.kill()
        for stream in (child.stdin, child.stdout):
            try:
                stream.close()
            except OSError:  # what wasn't sent yet needn't be
                pass
        return child.wait()

    def _start(self) -> None:
        paths = [ROOT, *(p for p in sys.path if p)]
        self.child = subprocess.Popen([sys.executable, "-c", _CHILD, str(self.memory), *paths], stdin=subprocess.PIPE, stdout=subprocess.PIPE, bufsize=0)
        os.set_blocking(self.child.stdout.fileno(), False)
        self._answer(self.function, START)

    def _answer(self, data: bytes, seconds: float):
        """Send this and wait for the answer until the time is up."""
        until = time.monotonic() + seconds
        message, got, need = memoryview(HEADER.pack(len(data)) + data), bytearray(), None
        os.set_blocking(self.child.stdin.fileno(), False)
        with selectors.DefaultSelector() as ready:
            ready.register(self.child.stdout, selectors.EVENT_READ)
            ready.register(self.child.stdin, selectors.EVENT_WRITE)
            while need is None or len(got) < need:
                left = until - time.monotonic()
                if left <= 0:
                    self._end()
                    raise CallError(f"not done within {seconds:g} seconds")
                for key, _ in ready.select(left):
                    if key.fileobj is self.child.stdin:
                        try:
                            message = message[os.write(key.fd, message) :]
                        except BrokenPipeError:
                            message = message[:0]  # the child is gone: its end is read below
                        if not message:
                            ready.unregister(self.child.stdin)
                        continue
                    part = os.read(key.fd, 1 << 20)
                    if not part:
                        code = self._ended()
                        raise CallError(f"the process ended with code {code}" if code is None or code >= 0 else f"the process was ended by signal {-code}")
                    got += part
                    if need is None and len(got) >= HEADER.size:
                        need = HEADER.size + HEADER.unpack(got[: HEADER.size])[0]
        return pickle.loads(bytes(got[HEADER.size :]))

    def _ended(self) -> int | None:
        """The code of a child that closed its output."""
        try:
            self.child.wait(5)
        except subprocess.TimeoutExpired:
            pass
        code = self.child.poll()
        self._end()
        return code

    def __call__(self, argument):
        """f(argument); a CallError if it raises, hangs, ends its process or takes too much memory."""
        if self.child is None:
            self._start()
        kind, value = self._answer(pickle.dumps(argument), self.deadline)
        if kind == "error":
            if value == "out of memory":
                self._end()
            raise CallError(value)
        return value
