"""The one transition of a sequence rule, for batch, streams and tests alike.

Masks tell what an event matches: a bit for each kind of step, bit 62 for the end condition. Steps that say the same share a bit, so that a
step may be asked for any number of times.
"""

from __future__ import annotations

from dataclasses import dataclass, field

UNTIL = 1 << 62
#: different steps of a rule
MAX_KINDS = 62


@dataclass
class Partial:
    """The match under way for one rule and key: the next step, when it began, and its events so far."""

    at: int
    began: int
    events: list[tuple] = field(default_factory=list)


def advance(partial: Partial | None, bits: tuple[int, ...], span_ns: int | None, mask: int, ts: int, event: tuple, sticky: bool = False) -> tuple[Partial | None, list[tuple] | None]:
    """The partial match after an event, and the events of the match that it completes, if it does.

    The end condition comes first and uses the event up. A live match waits for its next step only and passes over anything else. An event that
    comes for that step after the span (which counts from the first event; equality is within) is used up, too:
    it ends the match and starts none. ``sticky`` keeps a completed match open for its last step. ``bits`` has the bit of each event
    that a match needs, in order.
    """
    if mask & UNTIL:
        return None, None
    if partial is None:
        if not mask & bits[0]:
            return None, None
        if len(bits) == 1:
            return None, [event]
        return Partial(1, ts, [event]), None
    if not mask & bits[partial.at]:
        return partial, None
    if span_ns is not None and ts - partial.began > span_ns:
        return None, None
    if partial.at == len(bits) - 1:
        done = [*partial.events, event]
        return (partial if sticky else None), done
    return Partial(partial.at + 1, partial.began, [*partial.events, event]), None
