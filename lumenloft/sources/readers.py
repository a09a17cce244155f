"""Readers of files that may hang or crash, in a bounded pool of processes inside a task.

A caller's reader (an EXIF library, an image decoder) runs in `processes` children. A file that takes longer than `timeout_s`
loses its child, which is killed and replaced, and so does one that ends its child; either is one error row, and no other
file is lost. A child is replaced after `files` files, which bounds what a reader leaks. After `losses` lost children in a
row the circuit opens: the task's other files are error rows without a try, instead of a timeout each.

Errors: the reader's exception by name, READ_TIMEOUT, READER_CRASHED, READER_UNAVAILABLE."""

from __future__ import annotations

import multiprocessing
import os
import signal
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from multiprocessing.connection import Connection, wait


@dataclass(frozen=True)
class Limits:
    processes: int = 2
    timeout_s: float = 30.0
    files: int = 500
    losses: int = 5

    def __post_init__(self):
        if min(self.processes, self.files, self.losses) < 1 or self.timeout_s <= 0:
            raise ValueError("limits are positive")


class _Child:
    def __init__(self, reader: Callable):
        fork = multiprocessing.get_context("fork")
        self.ours, theirs = fork.Pipe()
        self.process = fork.Process(target=_serve, args=(reader, theirs, self.ours), daemon=True)
        self.process.start()
        theirs.close()
        self.at: int | None = None  # the place of the file that it reads
        self.since, self.done = 0.0, 0

    def ask(self, at: int, item) -> None:
        self.at, self.since = at, time.monotonic()
        self.ours.send(item)

    def end(self) -> None:
        if self.process.is_alive():
            os.kill(self.process.pid, signal.SIGKILL)
        self.process.join()
        self.ours.close()


def _serve(reader: Callable, pipe: Connection, other: Connection) -> None:
    other.close()
    while True:
        try:
            item = pipe.recv()
        except EOFError:
            os._exit(0)
        try:
            answer = (reader(item), None)
        except Exception as e:  # noqa: BLE001
            answer = (None, type(e).__name__)
        try:
            pipe.send(answer)
        except Exception as e:  # noqa: BLE001
            pipe.send((None, type(e).__name__))  # what can't be pickled


def read_all(items: Iterable, reader: Callable, limits: Limits = Limits()) -> Iterator[tuple[object, object, str | None]]:
    """(item, what the reader gave, error) in order of the items; a few items are read at a time."""
    waiting, children, answers = iter(items), [], {}
    held: dict[int, object] = {}
    asked = told = lost = 0
    more = True
    try:
        while more or held:
            while more and len(held) < 4 * limits.processes and (lost >= limits.losses or any(c.at is None for c in children) or len(children) < limits.processes):
                try:
                    item = next(waiting)
                except StopIteration:
                    more = False
                    break
                held[asked] = item
                if lost >= limits.losses:
                    answers[asked] = (None, "READER_UNAVAILABLE")
                else:
                    child = next((c for c in children if c.at is None), None)
                    if child is None:
                        children.append(child := _Child(reader))
                    try:
                        child.ask(asked, item)
                    except OSError:
                        pass  # it ended while idle; seen below as a crash
                asked += 1
            busy = [c for c in children if c.at is not None]
            if busy:
                first = min(c.since for c in busy) + limits.timeout_s
                ready = wait([c.ours for c in busy], max(0.0, first - time.monotonic()))
                now = time.monotonic()
                for c in busy:
                    error = None
                    if c.ours in ready:
                        try:
                            answers[c.at], lost = c.ours.recv(), 0
                            c.at, c.done = None, c.done + 1
                        except (EOFError, OSError):
                            error = "READER_CRASHED"
                    elif now - c.since >= limits.timeout_s:
                        error = "READ_TIMEOUT"
                    if error:
                        answers[c.at], lost = (None, error), lost + 1
                    if error or c.done >= limits.files:
                        children.remove(c)
                        c.end()
            while told in answers:
                yield held.pop(told), *answers.pop(told)
                told += 1
    finally:
        for c in children:
            c.end()
