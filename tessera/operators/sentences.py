"""Sentences built from fragments: covers, spaces that a scan lost, and signs that a cover guessed wrong.

Helpers for one sentence, and the Arrow UDFs that apply them to columns.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[^\w\s]|_")
#: Most states that a cover may try.
MOST_STATES = 200_000


def _tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text.replace("’", "'"))]


def cover_sentence(answer: str, fragments: list[str]) -> tuple[str, list[int]] | None:
    """Frame and order of the fragments that cover an answer; words that none covers stay in the frame.

    The cover that leaves the fewest words, then the fewest differences of case, is taken.  None if it holds fewer than two
    fragments or if another cover is as good: fragments of one text count as the same.  A dynamic programme over the place
    in the answer and the fragments used counts the best covers instead of listing them.
    """
    target, parts = _tokens(answer), [_tokens(f) for f in fragments]
    if not target or not all(parts):
        return None
    same: dict[str, list[int]] = {}
    for i, f in enumerate(fragments):
        same.setdefault(f.lower(), []).append(i)
    kinds = list(same.values())
    # (place, how many of each kind are used) -> (cost, number of ways, last step)
    layer: dict[tuple[int, ...], tuple[int, int, tuple | None]] = {(0,) * len(kinds): (0, 1, None)}
    layers: list[dict] = [{} for _ in range(len(target) + 1)]
    layers[0] = layer
    states = 0
    for at in range(len(target)):
        for used, (cost, ways, _) in layers[at].items():
            states += 1
            if states > MOST_STATES:
                return None
            word = any(ch.isalnum() for ch in target[at][0])
            steps = [(at + 1, used, cost + 100 * word, (used, at, None))]
            for k, members in enumerate(kinds):
                if used[k] == len(members):
                    continue
                part = parts[members[used[k]]]
                if [t[0].lower() for t in target[at : at + len(part)]] == [t[0].lower() for t in part]:
                    cased = sum(a[0] != b[0] for a, b in zip(target[at:], part, strict=False))
                    steps.append((at + len(part), (*used[:k], used[k] + 1, *used[k + 1 :]), cost + cased, (used, at, k)))
            for to, now, c, step in steps:
                old = layers[to].get(now)
                if old is None or c < old[0]:
                    layers[to][now] = (c, ways, step)
                elif c == old[0]:
                    layers[to][now] = (c, old[1] + ways, old[2])
    best = min(v[0] for v in layers[-1].values())
    ends = [(used, v) for used, v in layers[-1].items() if v[0] == best]
    if sum(v[1] for _, v in ends) > 1:
        return None
    slots, (used, state), at = [], ends[0], len(target)
    while state[2] is not None:
        before, begin, k = state[2]
        if k is not None:
            slots.append((kinds[k][before[k]], target[begin][1], target[at - 1][2]))
        used, at = before, begin
        state = layers[at][used]
    if len(slots) < 2:
        return None
    slots.reverse()
    frame, cursor = "", 0
    for _, start, end in slots:
        frame, cursor = frame + answer[cursor:start] + "_____", end
    return " ".join((frame + answer[cursor:]).split()), [i for i, _, _ in slots]


def squash(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", text.lower())


def rejoin_spaces(fragments: list[str], answer: str) -> tuple[list[str], str]:
    """Fragments and answer with the spaces that a scan lost, where the other side shows them.

    A fragment without a space whose letters are two to four consecutive words of the answer gets their spaces; a word of
    the answer that is exactly one pair of single-word fragments is parted.
    """
    words = answer.split(" ")
    first: dict[str, str] = {}
    for i in range(len(words)):
        for run in (words[i : i + k] for k in (2, 3, 4) if i + k <= len(words)):
            first.setdefault(squash("".join(run)), re.sub(r"[.,;:!?]+$", "", " ".join(run)))
    fragments = [f if " " in f else first.get(squash(f), f) for f in fragments]
    single = {squash(f) for f in fragments if " " not in f}
    out = []
    for word in words:
        core = squash(word)
        cuts = [s for s in range(1, len(core)) if core[:s] in single and core[s:] in single]
        if core not in single and len(cuts) == 1 and not re.search(r"[^A-Za-z.,;:!?]", word):
            at = cuts[0] + (not word[0].isalpha())
            word = f"{word[:at]} {word[at:]}"
        out.append(word)
    return fragments, " ".join(out)


def looks_whole(answer: str, fragments: list[str], used: int) -> bool:
    """Whether a scanned sentence is whole: it ends like one, at most one fragment is left, and none holds debris."""
    return bool(re.search(r"[.?!][\"'”’]?$", answer.strip())) and len(fragments) - used <= 1 and all(re.fullmatch(r"[A-Za-z][A-Za-z'’ ,.-]*", f) for f in fragments)


def left_in_frame(frame: str, order: list[int], fragments: list[str]) -> bool:
    """Whether an unused fragment also stands in the fixed words of a frame, whole, nearly or in part: the cover is then a guess."""
    fixed = [w for w in map(squash, re.sub(r"_{2,}", " ", frame).split()) if w]

    def printed(f: str) -> bool:
        letters = squash(f)
        for i in range(len(fixed)):
            run = ""
            for w in fixed[i:]:
                run += w
                if len(run) >= len(letters):
                    break
            if run == letters:
                return True
        near = any(w != letters and min(len(w), len(letters)) >= 2 and abs(len(w) - len(letters)) <= 2 and (w.startswith(letters) or w.endswith(letters) or letters.startswith(w) or letters.endswith(w)) for w in fixed)
        return near or (" " in f and any(squash(p) in fixed for p in f.split() if squash(p)))

    return any(i not in order and squash(f) and printed(f) for i, f in enumerate(fragments))


COVER = T.StructType([T.StructField("frame", T.StringType()), T.StructField("order", T.ArrayType(T.IntegerType())), T.StructField("inferred_text", T.BooleanType()), T.StructField("left_in_frame", T.BooleanType()), T.StructField("looks_whole", T.BooleanType())])


@F.pandas_udf(COVER)
def covers(answers: pd.Series, fragments: pd.Series) -> pd.DataFrame:
    """Cover of each answer: frame and order (null where there is none or it's ambiguous), and what speaks against it."""
    rows = []
    for answer, parts in zip(answers, fragments, strict=True):
        parts = [] if parts is None else [str(p) for p in parts]
        found = cover_sentence(answer, parts) if answer is not None else None
        if found is None:
            rows.append((None, None, None, None, None))
        else:
            frame, order = found
            rows.append((frame, order, bool(re.search("[A-Za-z]", re.sub(r"_{2,}", "", frame))), left_in_frame(frame, order, parts), looks_whole(answer, parts, len(order))))
    return pd.DataFrame(rows, columns=COVER.names)


REJOINED = T.StructType([T.StructField("fragments", T.ArrayType(T.StringType())), T.StructField("answer", T.StringType())])


@F.pandas_udf(REJOINED)
def rejoined(answers: pd.Series, fragments: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if a is None or f is None else rejoin_spaces([str(x) for x in f], a) for a, f in zip(answers, fragments, strict=True)]
    return pd.DataFrame(rows, columns=REJOINED.names)
