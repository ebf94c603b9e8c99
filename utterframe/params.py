"""Thresholds and word lists of the operators, as frozen parameters; times are milliseconds."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Timeline:
    """How a text without word times is laid out: integer arithmetic only, so every engine agrees."""

    ms_per_char: int = 60
    ms_per_word: int = 40
    gap: int = 40
    gap_comma: int = 250
    gap_stop: int = 900
    gap_speaker: int = 1200


@dataclass(frozen=True)
class Params:
    gap_min: int = 500  # a pause is a gap from here
    silence: int = 800  # a gap above this is too long, and is cut down to it
    silence_least_cut: int = 100
    sentence_slack: int = 500  # of a gap's start, around a sentence
    speaker_join: int = 1000
    merge_slack: int = 10
    contain_slack: int = 10
    snap: int = 200  # boundaries closer than this move to the neighbour
    onset_gap: int = 50
    rescan_least: int = 50
    filler_longest: int = 500
    near: int = 100
    stutter_gap: int = 500
    first_snap: int = 5000
    large_deletion: int = 5000
    cut_gap_least: int = 300
    cut_gap_most: int = 3000
    # Word lists are parameters of the language; these suit the English timeline of the tests.
    fillers: tuple[str, ...] = ("of", "and", "to", "in", "de", "la")
    fillers2: tuple[str, ...] = ("ofthe", "inthe", "tothe")
    fillers3: tuple[str, ...] = ("andofthe", "andinthe")
    ambiguous: tuple[str, ...] = ("the", "a")
    mid_fillers: tuple[str, ...] = ("is", "it", "er", "on", "de", "la")
    confirmations: tuple[str, ...] = ("that", "so")
    mid_special: str = "is"
    reduplicated: tuple[str, ...] = ("haha", "byebye")
    high_frequency: tuple[str, ...] = ("the", "of")
    markers: tuple[str, ...] = ("that", "with", "for")
    markers2: tuple[str, ...] = ("ofthat", "withthe")
    hesitations: tuple[str, ...] = ("er", "the", "a", "of")
    conjunctions: tuple[str, ...] = ("and", "but", "so")


PARAMS = Params()
