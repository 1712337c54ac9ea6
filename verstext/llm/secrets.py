"""Secret spans: three patterns, and strings that a tokenizer splits into unusually short tokens.

Text that people write needs few tokens per character under a vocabulary learnt from such text;
random strings need many. A run of key characters with a low number of characters per token is
reported as ``random``, or else each stretch of it that has a low number, so that a key inside a
path or an option is found. What a pattern has already found, digests of a known length and UUIDs
are cut out of a run first.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

from pyspark.sql import DataFrame, functions as F

from verstext.llm.rows import map_keyed, once_per_worker

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of 32 and more: a run is taken whole
LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
PART = re.compile(r"[A-Za-z0-9]+|[+/_=-]+")  # no token reaches over the end of a part
NUMBERED = re.compile(r"(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4})\Z")
# fixed values: digest lengths (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) and the UUID form
FIXED = re.compile(
    r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})(?![0-9A-Za-z])"
)
IDENTIFIER = re.compile(r"[A-Za-z]*[a-z]?[0-9]{0,4}(?:[_/=+-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4}))*[_/=+-]*\Z")
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches that pass their length tests."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def is_identifier(run: str) -> bool:
    """Words, snake_case, paths and numbered names: letters with short numbers at their ends."""
    return bool(IDENTIFIER.match(run)) or not any(c.isdigit() for c in run)


def left_over(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What sorted spans leave of a run, in pieces of the length of a candidate at least."""
    out = []
    for s, e in [*spans, (end, end)]:
        if min(s, end) - start >= LEAST:
            out.append((start, min(s, end)))
        start = max(start, e)
    return out


def part_gains(part: str, sizes: list[int], ratio: float) -> list[float]:
    """For each token what it has in excess of its share of tokens: positive sums have a low ratio.

    Separators count nothing, and a short word or number that stands alone speaks for no key.
    """
    if not part[0].isalnum():
        return [0.0] * len(sizes)
    gains = [ratio - n for n in sizes]
    if NUMBERED.match(part) and (part.isdigit() or len(sizes) <= 1 + part[-1].isdigit()):
        return [min(0.0, g) for g in gains]
    return gains


def low_stretches(run: str, encode, ratio: float) -> list[tuple[int, int]]:
    """The stretches with a low ratio: the one with the largest excess, then those beside it."""
    at, total, parts = [0], [0.0], []  # token bounds, sums of gains up to them, parts as token numbers
    for part in PART.findall(run):
        sizes = encode(part)
        parts += [(len(at) - 1, len(at) - 1 + len(sizes))] * len(sizes)
        for n, gain in zip(sizes, part_gains(part, sizes, ratio), strict=True):
            at.append(at[-1] + n)
            total.append(total[-1] + gain)
    found, open_ranges = [], [(0, len(parts))]
    while open_ranges:
        first, last = open_ranges.pop()
        low = behind = first
        best = None
        for j in range(first, last + 1):  # low: the bound with the smallest sum that is far enough to the left, the last of them
            while at[j] - at[behind] >= LEAST:
                low = behind if total[behind] <= total[low] else low
                behind += 1
            if behind > first and total[j] - total[low] > (best[0] if best else 1e-9):
                best = (total[j] - total[low], low, j)
        if best is None:
            continue
        _, i, j = best
        (a, b), (c, d) = parts[i], parts[j - 1]
        left, right = i, j  # a part that is low as a whole is taken whole
        if a >= first and b <= last and total[b] > total[a]:
            left, right = a, max(right, b)
        if c >= first and d <= last and total[d] > total[c]:
            left, right = min(left, c), max(right, d)
        found.append((at[left], at[right]))
        open_ranges += [(first, left), (right, last)]
    return sorted(found)


def random_spans(text: str, base: list[tuple[int, int, int]], encode, ratio: float) -> list[tuple[int, int, int]]:
    """Candidates without what patterns and fixed forms cover: low as a whole, or their low stretches."""
    found = []
    for m in CANDIDATE.finditer(text):
        known = [(s, e) for s, _, e in base if s < m.end() and m.start() < e]
        known += [(m.start() + f.start(), m.start() + f.end()) for f in FIXED.finditer(m[0])]
        for start, end in left_over(m.start(), m.end(), sorted(known)):
            run = text[start:end]
            if not is_identifier(run) and len(run) < ratio * len(encode(run)):
                found.append((start, 3, end))
            else:
                found += [(start + s, 3, start + e) for s, e in low_stretches(run, encode, ratio)]
    return found


def say(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def load_encoder(path_bytes: bytes):
    """A function that gives the lengths of the tokens of an ASCII string."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path_bytes.splitlines())}
    encode = tiktoken.Encoding("vocabulary", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    size = {rank: len(token) for token, rank in ranks.items()}
    return lambda run: [size[t] for t in encode(run)]


def scan_secrets(docs: DataFrame, vocabulary: str, ratio: float = 2.2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` of every row.

    ``vocabulary`` is a tiktoken rank file (fixed size), read on the driver and sent with the
    tasks; a run, or a stretch of at least 20 characters, is random below ``ratio`` characters per
    token. Offsets are code points with an
    exclusive end. A NULL or empty text has no spans: counts 0, ``spans`` an empty string and
    ``base_sha256`` its digest. Rows with a NULL or repeated key are scanned like any other. There is no shuffle.
    """
    with open(vocabulary, "rb") as f:
        shared, name = docs.sparkSession.sparkContext.broadcast(f.read()), uuid.uuid4().hex

    def start():
        encode = once_per_worker(name, lambda: load_encoder(shared.value))

        def scan(texts: list[str]):
            out = []
            for t in texts:
                base = base_spans(t)
                more = random_spans(t, base, encode, ratio)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                out.append((*n, len(more), hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(base + more))))
            return None, [list(c) for c in zip(*out, strict=True)]

        return scan

    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_keyed(rows, start, "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
