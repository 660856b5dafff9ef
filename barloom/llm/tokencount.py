"""Token counts with a tokenizers file, by overlap resynchronisation for huge texts.

Texts of up to chunk code points are counted in batches, a longer one in overlapping
chunks. Two neighbours are spliced at a position of their overlap at which both have a
token boundary and which is proven stable: white space after it, none before it. The split
pattern lets white space only start a match, so there a match ends whatever came before,
and a special string, which holds no white space, can't lie across it. Where an overlap has
no such position it is widened, then the chunk itself, up to the whole text.

Texts and chunks are cut into pieces at stable positions, and where a Latin letter or ASCII
digit meets a punctuation mark: no match holds a letter or number and then something else.
So a text has as many tokens as its pieces, and the library counts each piece once while
the process's cache holds it. That needs the byte-level split pattern, no normalizer,
dropout, truncation or padding, and special strings that no cut divides; with any other
file, and where most pieces are new, the library is given whole texts and chunks.

Null counts as empty: no bytes, no tokens. Repeated rows are counted each for itself.
Further columns pass through, but for those named like a column made here, whatever their
case: those are left out.
"""

from __future__ import annotations

import bisect
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

CHUNK, OVERLAP = 16_384, 512
#: Pieces in each of a cache's two generations, and the code points of the longest that is kept.
CACHE, LONGEST = 1 << 18, 64
# ASCII digits and Latin letters of blocks that are full, so that no version of Unicode tells them apart.
WORD, MARKS = "0-9A-Za-zÀ-ÖØ-öø-ɏ", ",.;:!?"
#: A text up to its next cut; most pieces are words and match the first branch.
PIECE = re.compile(rf" ?[{WORD}]+(?=[ \n\t{MARKS}]|\Z)|.+?(?=(?<=\S)[ \n\t]|(?<=[{WORD}])[{MARKS}]|\Z)", re.DOTALL)
_loaded: dict[int, object] = {}


def stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in " \n\t" and not text[at - 1].isspace()


def huge_ids(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
    """Ids of a text in runs. encode(text) gives (ids, starts): token starts in code points. Counts of pieces and their starts do as well.

    Holds two chunks at a time, however long the text is.
    """
    left, end = 0, min(chunk, len(text))
    ids, starts = encode(text[left:end])
    while end < len(text):
        wide, size = overlap, chunk
        while True:
            begin, until = max(left, end - wide), min(len(text), end + size)
            next_ids, next_starts = encode(text[begin:until])
            theirs = {s + begin for s in next_starts}
            shared = next((p for s in reversed(starts) if (p := s + left) > max(begin, left) and p < end and p in theirs and stable(text, p)), None)
            if shared is not None:
                break
            if begin > left:
                wide *= 2
            else:  # the overlap is the whole of the left chunk: take both as one
                left, end, ids, starts = begin, until, next_ids, next_starts
                if end == len(text):
                    break
                wide, size = overlap, size * 2
        if shared is None:
            break
        yield ids[: bisect.bisect_left(starts, shared - left)]
        k = bisect.bisect_left(next_starts, shared - begin)
        left, end, ids, starts = shared, until, next_ids[k:], [s + begin - shared for s in next_starts[k:]]
    yield ids


def tokenizer(data: str):
    """The process's tokenizer for the content of a json file."""
    key = hash(data)
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        _loaded[key] = Tokenizer.from_str(data)
    return _loaded[key]


def divisible(own) -> bool:
    """Whether a text has as many tokens as its pieces."""
    spec = json.loads(own.to_str())
    split = spec["pre_tokenizer"] or {}
    return (
        split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space", True)
        and not any([spec["normalizer"], spec["truncation"], spec["padding"], spec["model"].get("dropout")])
        and all(len(PIECE.findall(t["content"])) == 1 and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
    )


class Counter:
    """Counts of one tokenizer, with a cache of those of short pieces."""

    def __init__(self, own):
        self.own, self.divisible = own, divisible(own)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def library(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def batch(self, texts: list[str]) -> list[int]:
        found = self.pieces([PIECE.findall(t) for t in texts], sum) if self.divisible else None
        return self.library(texts) if found is None else found

    def pieces(self, cut: list[list[str]], of: Callable) -> list | None:
        """What of makes of the counts of each text's pieces; none if most are new, as the library takes a whole text faster than its pieces."""
        wanted = set().union(*cut)
        missing = wanted.difference(self.young)
        known = {p: self.old[p] for p in missing if p in self.old}
        new = [p for p in missing if p not in known]
        if 2 * len(new) > sum(map(len, cut)):
            return None
        if len(self.young) + len(missing) > CACHE:  # what wasn't wanted for a generation goes
            known.update((p, self.young[p]) for p in wanted - missing)
            self.old, self.young = self.young, {}
        self.young.update(known)
        self.young.update(zip(new, self.library(new)))
        out = [of(map(self.young.__getitem__, c)) for c in cut]
        for p in new:
            if len(p) > LONGEST:
                del self.young[p]
        return out

    def encode(self, part: str) -> tuple[list[int], list[int]]:
        """Counts of a chunk's pieces, or of its tokens, and where they start. Both start at every stable position."""
        if self.divisible:
            cut = PIECE.findall(part)
            found = self.pieces([cut], list)
            if found is not None:
                return found[0], list(accumulate(map(len, cut[:-1]), initial=0))
        e = self.own.encode(part, add_special_tokens=False)
        return [1] * len(e.ids), [a for a, _ in e.offsets]


@lru_cache(4)
def counter(own) -> Counter:
    return Counter(own)


def counts(texts: list[str], own, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    by = counter(own)
    out = [0] * len(texts)
    group: list[int] = []
    size = 0

    def flush() -> None:
        for k, n in zip(group, by.batch([texts[k] for k in group])):
            out[k] = n
        group.clear()

    for k, text in enumerate(texts):
        if len(text) > chunk:
            out[k] = sum(map(sum, huge_ids(text, by.encode, chunk, overlap)))
        elif text:
            group.append(k)
            size += len(text)
            if size > 8 * CHUNK:
                flush()
                size = 0
    flush()
    return out


def count_tokens(df: DataFrame, json_file: str, text: str = "text", keep: list[str] | None = None, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The kept columns (all by default) with n_bytes, n_tokens and over_limit. One pass, no shuffle; the file's content, of fixed size, is broadcast."""
    with open(json_file, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    made = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n for n, _ in made}]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, t) for c, t in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                texts = [t or "" for t in some.column(some.num_columns - 1).to_pylist()]
                n = counts(texts, own, chunk, overlap)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=schema.names)

    return common.ready(df).select(*[df[c] for c in keep], df[text].alias("_text")).mapInArrow(common.tidy(run), schema)
