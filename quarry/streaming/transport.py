"""Live sessions behind a transport: send a line, read events until one fits or a deadline passes."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

from . import sessions


class Transport(Protocol):
    """What a session is talked to through: a serial port, a socket, or this process."""

    def send(self, line: str) -> None: ...

    def poll(self) -> dict | None:
        """The next event if there is one now."""


class InProcess:
    """A session in this process, without a device."""

    def __init__(self):
        self.state, self.seq, self.events = sessions.EMPTY, 0, deque([{"seq": -1, "event": "ready"}])

    def send(self, line: str) -> None:
        self.state, event = sessions.step(self.state, line)
        fan, heat, win, history = self.state
        self.events.append({"seq": self.seq, "event": event, "fan": fan, "heat": heat, "win": win, "kept": len(history), "bytes": sum(history)})
        self.seq += 1

    def poll(self) -> dict | None:
        return self.events.popleft() if self.events else None


def read_until(transport: Transport, fits: Callable[[dict], bool], seconds: float, clock: Callable[[], float] = time.monotonic, pause: Callable[[float], None] = time.sleep) -> tuple[list[dict], bool]:
    """The events up to the first that fits, and whether one did before the deadline."""
    out, end = [], clock() + seconds
    while clock() < end:
        event = transport.poll()
        if event is None:
            pause(0.01)
            continue
        out.append(event)
        if fits(event):
            return out, True
    return out, False


def run_cases(transport: Transport, cases: list[str], boot: float = 10, answer: float = 60, **clock) -> Iterator[dict]:
    """The last event of each line, after the session is ready; TimeoutError names a line that got none."""
    if not read_until(transport, lambda e: e["event"] == "ready", boot, **clock)[1]:
        raise TimeoutError("not ready")
    for line in cases:
        transport.send(line)
        events, found = read_until(transport, lambda e: True, answer, **clock)
        if not found:
            raise TimeoutError(line)
        yield events[-1]
