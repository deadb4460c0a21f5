"""State machines of one key: small, serializable, used by batch and stream alike."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

BREAK = re.compile(r"[.!?]\s|\n\n")


@dataclass
class Throttle:
    """Accepts an event at least `gap` after the last accepted one; only acceptance moves the clock."""

    gap: float
    last: float | None = None

    def feed(self, t: float) -> bool:
        if self.last is not None and t - self.last < self.gap:
            return False
        self.last = t
        return True


@dataclass
class SentenceBuffer:
    """Tokens in, stretches out: up to the first sentence end, if that stretch is long enough; a short one blocks."""

    least: int = 15
    held: str = ""

    def feed(self, token: str) -> list[str]:
        self.held += token
        out: list[str] = []
        while (m := BREAK.search(self.held)) and len(self.held[: m.end()].strip()) >= self.least:
            out.append(self.held[: m.end()])
            self.held = self.held[m.end() :]
        return out

    def flush(self) -> list[str]:
        rest, self.held = self.held, ""
        return [rest]


@dataclass
class Segmenter:
    """Voice segments of 30 ms frames: begins with `onset` speech frames in a row, ends after the silence. After cap_ms of
    listening, the frames before the onset included, what is there is a segment and listening starts anew."""

    silence_ms: int = 800
    onset: int = 3
    cap_ms: int = 60_000
    heard: int = 0
    run: int = 0
    begin: int | None = None
    quiet: int = 0
    last: int = 0

    def feed(self, frame: int, speech: bool) -> tuple[int, int] | None:
        """(first frame, last frame) when a segment ends here."""
        self.heard, self.last = self.heard + 1, frame
        if self.begin is not None:
            self.quiet = 0 if speech else self.quiet + 1
        else:
            self.run = self.run + 1 if speech else 0
            if self.run == self.onset:
                self.begin = frame - self.onset + 1
        silent = self.begin is not None and self.quiet >= self.silence_ms // 30
        return self.flush(frame) if silent or self.heard >= self.cap_ms // 30 else None

    def flush(self, frame: int) -> tuple[int, int] | None:
        begin = self.begin if self.begin is not None else frame - self.run + 1
        some = self.begin is not None or self.run > 0
        self.heard, self.run, self.begin, self.quiet = 0, 0, None, 0
        return (begin, frame) if some else None


@dataclass
class Onset:
    """A leaky counter: up with speech, down with silence, never under 0; fires at `level` with the last frames before it."""

    level: int = 3
    keep: int = 5
    count: int = 0
    before: list[int] = field(default_factory=list)

    def feed(self, frame: int, speech: bool) -> list[int] | None:
        self.before = [*self.before, frame][-self.keep :]
        self.count = self.count + 1 if speech else max(self.count - 1, 0)
        if self.count < self.level:
            return None
        out, self.before, self.count = self.before, [], 0
        return out
