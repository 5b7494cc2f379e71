"""Format and delimiter of a text file, from its name and its first bytes."""

from __future__ import annotations

from collections import Counter

# Candidates in order of preference; what of a file is looked at.
DELIMITERS = (",", "\t", ";", "|")
SAMPLE_BYTES, SAMPLE_RECORDS = 65_536, 50


def detect_format(name: str, head: bytes) -> str:
    """delimited, json (an array or one object after another in a .json file) or ndjson."""
    low = name.lower()
    first = head.removeprefix(b"\xef\xbb\xbf").lstrip()[:1]
    if low.endswith((".ndjson", ".jsonl")):
        return "ndjson"
    if low.endswith((".csv", ".tsv", ".txt")):
        return "delimited"
    return {b"[": "json", b"{": "ndjson"}.get(first, "delimited")


def records(text: str, delimiter: str, most: int = SAMPLE_RECORDS) -> list[int]:
    """Field counts of the first records of a sample; the last one counts only if the sample ends it or has no other."""
    from quarry.sources.delimited import tokenize

    found = []
    for fields, _ in tokenize(text, delimiter):
        found.append(len(fields))
        if len(found) >= most:
            break
    return found


def sniff_delimiter(sample: str, name: str = "") -> str:
    """The candidate whose most frequent field count covers most records; more fields break near ties."""
    if name.lower().endswith(".tsv"):
        return "\t"
    best, top = DELIMITERS[0], 0.0
    for candidate in DELIMITERS:
        counts = Counter(n for n in records(sample[:SAMPLE_BYTES], candidate))
        if not counts:
            continue
        mode, times = max(counts.items(), key=lambda kv: (kv[1], kv[0]))
        score = 0.0 if mode <= 1 else times / sum(counts.values()) * 100 + min(mode - 1, 64) * 0.5
        if score > top:
            best, top = candidate, score
    return best
