"""Labels of conversation segments and their groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fine labels in order of priority (the earlier wins where segments of a channel overlap), with the canonical label and the group of each.
FINE = [
    ("Floor-taking Competitive Interruption", "Interruption", "floor_taking"),
    ("Floor-taking Cooperative Interruption", "Interruption", "floor_taking"),
    ("Non-floor Taking Competitive Interruption", "NonFloorTakingInterruption", "attempt"),
    ("Non-floor Taking Cooperative Interruption", "NonFloorTakingInterruption", "attempt"),
    ("Normal Turn", "Turn", "turn"),
    ("Strong Floor Hold", "Turn", "turn"),
    ("Bounded Response", "Turn", "turn"),
    ("Overlap", "Turn", "turn"),
    ("Filler", "Turn", "turn"),
    ("Reaction Backchannel", "Backchannel", "backchannel"),
    ("Acknowledgement Backchannel", "Backchannel", "backchannel"),
    ("Continuer Backchannel", "Backchannel", "backchannel"),
    ("Laughter", "Laughter", "noncontent"),
    ("Speech, Non-Linguistic", "NonContent", "noncontent"),
    ("Non-Speech Noise", "NonContent", "noncontent"),
    ("Channel Bleed", "NonContent", "noncontent"),
    ("Awkward Silence", "AwkwardSilence", None),
]
# The act of each canonical label.
ACTS = [
    ("Turn", "CLAIM"), ("Interruption", "CLAIM"), ("NonFloorTakingInterruption", "CLAIM"), ("Backchannel", "BACKCHANNEL"), ("Laughter", "LAUGHTER"), ("NonContent", "NONCONTENT"),
]
ALIAS = {"Regular Turn": "Normal Turn"}
TURN_VIEW = ("Turn", "Interruption")


def _by_value(label: Column, pairs: list[tuple[str, str | None]], default: object) -> Column:
    """The value of a label: a branch for each value, with all labels that have it."""
    named: dict[str, list[str]] = {}
    for name, value in pairs:
        if value is not None:
            named.setdefault(value, []).append(name)
            named[value] += [old for old, new in ALIAS.items() if new == name]
    out = F.lit(default).cast("string")
    for value, names in reversed(named.items()):
        out = F.when(label.isin(*names), F.lit(value)).otherwise(out)
    return out


def fine(label: Column) -> Column:
    """The label by its proper name."""
    out = label
    for old, new in ALIAS.items():
        out = F.when(label == old, F.lit(new)).otherwise(out)
    return out


def canonical(label: Column) -> Column:
    """The canonical label; null for an unknown one."""
    return _by_value(label, [(n, c) for n, c, _ in FINE], None)


def act(label: Column) -> Column:
    """What the speaker does by a label: SILENT for unknown ones and lapses."""
    acts = dict(ACTS)
    return _by_value(label, [(n, acts.get(c)) for n, c, _ in FINE], "SILENT")


def group_of_index(index: Column) -> Column:
    """The group of a place in the order of priority; null for 0 and for what has none."""
    return F.get(F.array(F.lit(None).cast("string"), *[F.lit(g).cast("string") for _, _, g in FINE]), index.cast("int"))


def group(label: Column) -> Column:
    """The group of a label; null for an unknown one and for one that has none."""
    return _by_value(label, [(n, g) for n, _, g in FINE], None)


def fine_index(label: Column) -> Column:
    """Place in the order of priority, from 1; 0 for silence and unknown labels."""
    return F.coalesce(F.array_position(F.array(*[F.lit(n) for n, _, _ in FINE]), fine(label)), F.lit(0)).cast("int")
