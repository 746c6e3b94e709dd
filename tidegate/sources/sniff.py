"""Encoding, delimiter and header row of a text file, from its first bytes."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

SNIFF_BYTES = 128 * 1024
SNIFF_LINES = 60
DELIMITERS = (",", ";", "\t", "|")
_NUMERIC = re.compile(r"[$€£¥]?-?[\d.,\s]+%?\Z")


@dataclass(frozen=True)
class Sniff:
    encoding: str
    delimiter: str
    header_row: int
    column_count: int
    preamble: tuple[str, ...]
    header: tuple[str, ...]


def detect_encoding(head: bytes) -> str:
    """utf-8-sig, utf-8, or a single-byte code page; a character cut at the end of the sample is no fault."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    for cut in range(4):
        try:
            head[: len(head) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError as e:
            if e.start < len(head) - 4:
                break
    try:
        head.decode("cp1252")
        return "cp1252"
    except UnicodeDecodeError:
        return "iso-8859-1"


def cells(line: str, delimiter: str) -> list[str]:
    """Cells of one line; a delimiter inside quotes does not separate."""
    out, inside, held = [], False, []
    for part in re.split(f'("|{re.escape(delimiter)})', line):
        if part == '"':
            inside = not inside
        elif part == delimiter and not inside:
            out.append("".join(held).strip())
            held = []
        else:
            held.append(part)
    return [*out, "".join(held).strip()]


def detect_delimiter(lines: list[str]) -> str:
    """The candidate with the most cells on the most lines; the earlier of equals."""
    scores = {}
    for d in DELIMITERS:
        widths = Counter(w for line in lines if line.strip() and (w := line.count(d) + 1) >= 2)
        (width, n) = max(widths.items(), key=lambda x: x[1], default=(0, 0))
        scores[d] = n / max(1, len(lines)) * width
    return max(DELIMITERS, key=lambda d: scores[d])


def detect_header_row(lines: list[str], delimiter: str) -> int:
    """The first line of the usual width whose cells all name something, else the first of that width, else 0."""
    rows = [cells(x, delimiter) for x in lines]
    widths = Counter(len(r) for r in rows if len(r) >= 2)
    if not widths:
        return 0
    usual = max(widths.items(), key=lambda x: x[1])[0]
    wide = [i for i, r in enumerate(rows) if len(r) == usual]

    def names(row: list[str]) -> bool:
        return all(row) and not any(_NUMERIC.match(c) for c in row) and len({c.lower() for c in row}) == len(row)

    return next((i for i in wide if names(rows[i])), wide[0])


def sniff(head: bytes) -> Sniff:
    encoding = detect_encoding(head[:SNIFF_BYTES])
    lines = head[:SNIFF_BYTES].decode(encoding, "replace").splitlines()[:SNIFF_LINES]
    delimiter = detect_delimiter(lines)
    at = detect_header_row(lines, delimiter)
    header = cells(lines[at], delimiter) if lines else []
    return Sniff(encoding, delimiter, at, len(header), tuple(lines[:at]), tuple(header))
