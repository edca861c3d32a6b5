"""Trajectory transforms: frames in, frames out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, zeros

MAX_FRAMES, MIN_FRAMES, JOINTS = 42, 2, 21
#: Frames in a tubelet and tokens of one.
TUBELET_FRAMES, TUBELET_TOKENS = 2, 576

#: Joint pairs whose distances make a frame's 160 features; joints 0-20 are the left hand, 21-41 the right.
#: 40 pairs across hands, then 60 within the left hand; the last 60 are the same within the right.
CROSS_PAIRS = [
    (11, 35), (10, 35), (11, 30), (10, 31), (15, 35), (11, 31), (11, 34), (14, 31), (10, 30), (14, 35),
    (15, 30), (15, 31), (9, 31), (14, 32), (10, 32), (14, 30), (11, 36), (15, 34), (10, 36), (9, 35),
    (15, 36), (10, 34), (14, 36), (9, 32), (5, 31), (15, 32), (11, 32), (5, 35), (9, 30), (9, 36),
    (14, 34), (5, 30), (11, 39), (5, 32), (13, 31), (7, 35), (6, 35), (2, 30), (12, 35), (13, 32),
]
LEFT_PAIRS = [
    (0, 9), (0, 17), (0, 13), (1, 9), (0, 5), (5, 17), (1, 17), (1, 5), (1, 13), (9, 17),
    (5, 13), (5, 6), (0, 1), (9, 10), (1, 2), (13, 14), (2, 3), (5, 9), (9, 13), (10, 11),
    (14, 15), (6, 7), (17, 18), (11, 12), (13, 17), (7, 8), (1, 3), (18, 19), (15, 16), (0, 3),
    (0, 2), (3, 4), (0, 14), (0, 6), (0, 10), (6, 8), (10, 12), (0, 11), (0, 15), (0, 7),
    (1, 14), (2, 10), (2, 15), (0, 18), (11, 19), (1, 10), (2, 11), (1, 15), (13, 15), (1, 6),
    (1, 11), (11, 13), (14, 16), (2, 14), (5, 18), (1, 7), (2, 4), (1, 18), (5, 15), (12, 17),
]


def joint_pairs() -> list[tuple[int, int]]:
    return CROSS_PAIRS + LEFT_PAIRS + [(a + JOINTS, b + JOINTS) for a, b in LEFT_PAIRS]


def joint_layout(dim: int) -> tuple[int, int]:
    """(joints per hand, coordinates) of a frame width."""
    for joints in (7, JOINTS):
        if dim % (2 * joints) == 0 and dim // (2 * joints) in (2, 3):
            return joints, dim // (2 * joints)
    raise ValueError(f"no joint layout has {dim} numbers")


def absolute(frames: Column, dim: int) -> Column:
    if joint_layout(dim) != (JOINTS, 3):
        raise ValueError("absolute coordinates need 21 joints in 3-D")
    return frames


def interjoint(frames: Column, dim: int) -> Column:
    """Distances of the fixed joint pairs in each frame."""
    if joint_layout(dim) != (JOINTS, 3):
        raise ValueError("joint distances need 21 joints in 3-D")
    pairs = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in joint_pairs()))

    def distance(frame: Column, pair: Column) -> Column:
        square = lambda k: F.pow(F.get(frame, pair[0] * 3 + k) - F.get(frame, pair[1] * 3 + k), F.lit(2.0))
        return F.sqrt(square(0) + square(1) + square(2))

    return F.transform(frames, lambda f: F.transform(pairs, lambda p: distance(f, p)))


TRANSFORMS: dict[str, Callable] = {"absolute": absolute, "interjoint": interjoint}


@dataclass(frozen=True)
class Design:
    """What is compared and how: a transform, a method and a norm by name."""

    transform: str
    method: str = "symmetric2"
    norm: str = "mean_length"


DESIGNS = {"abs_21j_coords": Design("absolute"), "pca_interjoint_dists": Design("interjoint")}


def design(name: str) -> Design:
    if name not in DESIGNS:
        raise ValueError(f"unknown design {name!r}; one of {sorted(DESIGNS)}")
    return DESIGNS[name]


def gap_fill(hand: Column, width: int, fill: str = "ffill") -> Column:
    """Fills missing frames (null rows) of one hand: before the first detection with it, after the last with that; between,
    with the one before (`ffill`) or the nearest, the earlier of two (`nearest`). No detection at all gives zeros."""
    if fill not in ("ffill", "nearest"):
        raise ValueError(f"unknown fill {fill!r}")

    def filled(hand: Column) -> Column:
        n = F.size(hand)
        detected = F.filter(F.transform(hand, lambda f, i: F.when(f.isNotNull(), i)), lambda i: i.isNotNull())

        def spans(at: Column) -> Column:
            """Each detection as often as frames take it: from where its span begins to where the next one's does."""

            def begin(k: Column) -> Column:
                first = F.get(at, k) if fill == "ffill" else F.lit(1) + F.floor((F.get(at, k - 1) + F.get(at, k)) / 2).cast("int")
                return F.when(k == 0, F.lit(0)).when(k == F.size(at), n).otherwise(first)

            each = F.flatten(F.transform(at, lambda i, k: F.array_repeat(F.get(hand, i), begin(k + 1) - begin(k))))
            return F.when(F.size(at) > 0, each).otherwise(F.array_repeat(zeros(width), n))

        return let(detected, spans)

    return let(hand, filled)  # read once, not for each frame


def truncate(frames: Column, max_frames: int = MAX_FRAMES) -> Column:
    return F.slice(frames, 1, max_frames)


def pad_to(frames: Column, width: Column) -> Column:
    """Repeats the last frame up to `width` frames."""
    return F.concat(frames, F.array_repeat(F.element_at(frames, -1), width - F.size(frames)))


def centre_crop(tokens: Column, max_frames: int, per_tubelet: int = TUBELET_TOKENS) -> Column:
    """Keeps the middle tubelets of a token array; of an odd number too many, one more goes from the end."""
    keep = max_frames // TUBELET_FRAMES
    extra = F.greatest((F.size(tokens) / per_tubelet).cast("int") - keep, F.lit(0))
    start = F.floor(extra / 2).cast("int") * per_tubelet + 1
    return F.when(extra > 0, F.slice(tokens, start, F.lit(keep * per_tubelet))).otherwise(tokens)
