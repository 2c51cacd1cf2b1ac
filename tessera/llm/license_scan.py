"""Licence scan: an Aho-Corasick pass over normalised words finds notice phrases, identifier tags give expressions.

Phrases are matched as whole words in a row.  Texts that carry a tag are read again for their expressions, which a
shunting-yard parser evaluates: OR takes the most permissive operand, AND the least permissive, WITH relaxes its licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases that this scan adds, with labels.
MORE_PHRASES = {
    "affero general public license": "agpl", "lesser general public license": "lgpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "bsd license": "bsd", "isc license": "isc", "boost software license": "boost", "artistic license": "artistic", "zlib license": "zlib",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0": "cc0", "public domain": "public-domain", "all rights reserved": "reserved",
}
#: Phrase before an expression, as normalised words.
TAG = "spdx license identifier"
TAG_START = re.compile(r"spdx-license-identifier:[ \t]*", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"[()\n\r]|[^\s()]+")
#: An identifier with what may stand around it: opening quotes before, anything after.
_OPERAND = re.compile(r"([\"'`]*)([a-z0-9][a-z0-9.+:_-]*)", re.IGNORECASE | re.ASCII)
#: Families of licence identifiers as prefixes, with their degree of permissiveness from 0 (no reuse) to 1
#: (free reuse).  The label of a family is its prefix, unless FAMILY_LABELS names another.
FAMILIES = {
    "0bsd": 1.0, "aal": 0.9, "abstyles": 0.9, "afl": 0.9, "agpl": 0.1, "aladdin": 0.2, "apache": 0.95, "apsl": 0.5, "artistic": 0.8, "beerware": 1.0, "bittorrent": 0.5, "blueoak": 1.0, "bsd": 1.0, "bsl": 1.0, "busl": 0.1,
    "bzip2": 1.0, "cal": 0.2, "caldera": 0.8, "catosl": 0.5, "cc-by": 0.8, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "cc-by-sa": 0.5, "cc-pddc": 1.0, "cc0": 1.0, "cddl": 0.5, "cdla-permissive": 0.9, "cdla-sharing": 0.5, "cecill": 0.3,
    "cern-ohl-p": 0.9, "cern-ohl-s": 0.2, "cern-ohl-w": 0.5, "clartistic": 0.8, "cpal": 0.3, "cpl": 0.5, "cua-opl": 0.5, "curl": 1.0, "ecl": 0.9, "efl": 0.9, "elastic": 0.1, "entessa": 0.9, "epl": 0.6, "erlpl": 0.5, "etalab": 0.8,
    "eudatagram": 0.9, "eupl": 0.4, "fair": 1.0, "frameworx": 0.5, "freetype": 0.9, "ftl": 0.9, "gfdl": 0.2, "gpl": 0.2, "hippocratic": 0.2, "hpnd": 1.0, "icu": 1.0, "ijg": 1.0, "imagemagick": 0.9, "intel": 0.9, "ipa": 0.6, "ipl": 0.5, "isc": 1.0,
    "jasper": 1.0, "json": 0.8, "latex2e": 0.8, "lgpl": 0.5, "libpng": 1.0, "liliq-p": 0.9, "liliq-r": 0.4, "lpl": 0.5, "lppl": 0.7, "mit": 1.0, "miros": 1.0, "motosoto": 0.5, "mpl": 0.6, "ms-pl": 0.8, "ms-rl": 0.4, "mulanpsl": 0.9,
    "multics": 0.9, "nasa": 0.6, "naumen": 0.9, "ncsa": 1.0, "nist": 1.0, "nokia": 0.5, "nosl": 0.3, "nposl": 0.2, "npl": 0.5, "ntp": 1.0, "o-uda": 0.8, "oclc": 0.5, "odbl": 0.4, "odc-by": 0.8, "ofl": 0.7, "ogc": 0.9, "ogl": 0.8, "ogtsl": 0.7,
    "oldap": 0.9, "openssl": 0.9, "opl": 0.5, "osl": 0.2, "parity": 0.1, "pddl": 1.0, "php": 0.9, "plexus": 1.0, "polyform": 0.1, "postgresql": 1.0, "prosperity": 0.1, "psf": 0.95, "python": 0.95, "qpl": 0.3, "rpl": 0.1, "rpsl": 0.4, "rscpl": 0.5,
    "ruby": 0.8, "sgi": 0.9, "simpl": 0.3, "sissl": 0.5, "sleepycat": 0.3, "spl": 0.5, "sspl": 0.05, "tcl": 1.0, "ucl": 0.4, "unicode": 0.95, "unlicense": 1.0, "upl": 0.95, "vim": 0.6, "vsl": 0.9, "w3c": 0.95, "watcom": 0.4, "wtfpl": 1.0, "x11": 1.0,
    "xnet": 1.0, "zend": 0.9, "zlib": 1.0, "zpl": 0.9,
}
FAMILY_LABELS = {"0bsd": "bsd", "bsl": "boost", "unlicense": "public-domain", "cc-pddc": "public-domain", "pddl": "public-domain"}
#: Families by length, the longest first.
IDENTIFIERS = [(f, FAMILY_LABELS.get(f, f), FAMILIES[f]) for f in sorted(FAMILIES, key=lambda f: (-len(f), f))]
#: What each kind of evidence adds to the score, as independent chances.
TAG_WEIGHT, BASE_WEIGHT, MORE_WEIGHT = 0.95, 0.8, 0.6

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive double"

_SEPARATORS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_machines: list = []


def _machine():
    if not _machines:
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase, label in {**MORE_PHRASES, **BASE_PHRASES}.items():
            found.add_word(f" {phrase} ", (phrase, label, phrase in BASE_PHRASES))
        found.add_word(f" {TAG} ", (TAG, None, False))
        found.make_automaton()
        _machines.append(found)
    return _machines[0]


def identifier(name: str) -> tuple[str, float]:
    """Label and permissiveness of a licence identifier; unknown ones are 'other' with 0."""
    for prefix, label, degree in IDENTIFIERS:
        if name == prefix or name.startswith(prefix + "-") or prefix.startswith("cc-by") and name.startswith(prefix):
            return label, degree
    return "other", 0.0


def evaluate(expression: str) -> tuple[list[str], float] | None:
    """(labels, permissiveness) of a licence expression by the shunting-yard method, None where it is malformed.

    Operators and/or/with are known in upper or lower case; + after an identifier means "or later" and is ignored.
    """
    output: list[tuple[list[str], float]] = []
    waiting: list[str] = []

    def apply(op: str) -> bool:
        if len(output) < 2:
            return False
        (b, y), (a, x) = output.pop(), output.pop()
        if op == "with":
            output.append((a, min(1.0, x + 0.2)))
        else:
            output.append((a + b, max(x, y) if op == "or" else min(x, y)))
        return True

    operand_next = True
    for token in re.findall(r"[()]|[^\s()]+", expression.lower()):
        if token in _PRECEDENCE:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= _PRECEDENCE[token]:
                if not apply(waiting.pop()):
                    return None
            waiting.append(token)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                if not apply(waiting.pop()):
                    return None
            if not waiting or operand_next:
                return None
            waiting.pop()
        else:
            if not operand_next:
                return None
            label, degree = identifier(token.rstrip("+"))
            output.append(([] if waiting and waiting[-1] == "with" else [label], degree))
            operand_next = False
    while waiting:
        if waiting[-1] == "(" or not apply(waiting.pop()):
            return None
    return output[0] if len(output) == 1 else None


def leading_expression(text: str, start: int) -> tuple[str, str]:
    """The expression that stands from start on in its line: as it stands, and as bare tokens for evaluate().

    It ends before the first token that cannot go on with it: a second operand in a row, a closing parenthesis without an
    opening one, or the end of the line.  Quotes and punctuation after an identifier end it too, but for closing
    parentheses.  A line whose expression is cut short is left for evaluate() to refuse.
    """
    tokens: list[str] = []
    first, last, depth, operand_next, ended = None, start, 0, True, False
    for m in _TOKEN.finditer(text, start):
        token, end = m[0], m.end()
        if token == ")":
            if not depth or operand_next:
                break
            depth -= 1
        elif ended or token in "\n\r":
            break
        elif token == "(":
            if not operand_next:
                break
            depth += 1
        elif token.lower() in _PRECEDENCE:
            tokens.append(token)
            first, last = m.start() if first is None else first, end
            if operand_next:
                break
            operand_next = True
            continue
        else:
            found = _OPERAND.match(token) if operand_next else None
            name = found[2].rstrip(".:_-") if found else ""
            if not name:
                break
            rest = token[found.start(2) + len(name) :]
            quoted = bool(rest) and rest == found[1][::-1]
            ended = bool(rest) and not quoted
            begin = m.start() + (0 if quoted else found.start(2))
            first = begin if first is None else first
            tokens.append(name)
            last, operand_next = end if quoted else end - len(rest), False
            continue
        tokens.append(token)
        first, last = m.start() if first is None else first, end
    return text[start if first is None else first : last], " ".join(tokens)


def scan_text(text: str | None) -> tuple:
    """The columns of SCHEMA after doc_id for one text; null counts as empty."""
    text = text or ""
    found = text.encode("utf-8", "surrogatepass").translate(_SEPARATORS).split()
    joined = f" {b' '.join(found).decode('utf-8', 'surrogatepass')} "
    base, labels, miss, tagged = [], set(), 1.0, False
    base_labels: set[str] = set()
    for end, (phrase, label, is_base) in _machine().iter(joined):
        if label is None:
            tagged = True
            continue
        labels.add(label)
        miss *= 1 - (BASE_WEIGHT if is_base else MORE_WEIGHT)
        if is_base:
            base_labels.add(label)
            base.append(end + 1 - len(phrase) - 2)
    expressions, degrees = [], []
    for m in TAG_START.finditer(text) if tagged else ():
        written, bare = leading_expression(text, m.end())
        if value := evaluate(bare):
            expressions.append(written)
            labels.update(value[0])
            degrees.append(value[1])
            miss *= 1 - TAG_WEIGHT
    first, last = (joined.count(" ", 0, min(base)), joined.count(" ", 0, max(base))) if base else (None, None)
    return len(found), len(base), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1 - miss, expressions, min(degrees) if degrees else None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = [(doc, *scan_text(text)) for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs, in one pass without a shuffle.

    Null and empty texts have no words, no labels (empty strings), null positions and score 0.  Repeated rows are
    scanned each for itself; other columns are not read; an empty table gives an empty table.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, SCHEMA)
