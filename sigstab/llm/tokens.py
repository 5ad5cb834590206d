"""Exact token counts at every prefix of a text, by prefix dynamic programming.

The model is a byte-pair model of sentencepiece: spaces become a mark, one mark is put before the text, and merges never
join a character with a mark behind it. So a text falls into segments (marks, then other characters) that are encoded
independently. Inside a segment the dynamic program runs over its prefixes: the encoding of a prefix is the encoding of
a shorter prefix and one last token, and that token is the longest one which ends there and forms with the token before
it a pair that the library itself keeps as it is. count[i] = count[i - len(last)] + 1. Characters outside the vocabulary
count a token for each of their bytes. The library encodes each distinct segment once; if its count for the whole
segment differs from the program's, every prefix of that segment is encoded by the library instead.

``count_tokens`` reads the count at the last prefix, ``prefix_table`` has the counts at every code point; both run the
program over each distinct segment that a worker doesn't remember, in sorted order, so shared beginnings run once.

With the counts stored, ``truncate_at`` and ``fits`` answer budget questions by looking them up and never encode again.

Defined results: null and empty texts have no tokens; an empty prefix has none; rows are never merged or dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MARK = "▁"
SEGMENT = re.compile(" *[^ ]+| +")
#: Segments that a worker remembers in each of two generations, a batch's own beside; a bound on memory that doesn't change results.
REMEMBERED = 400_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixCounter:
    """Token counts at every prefix, for one model file."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        lib, n = self.library, self.library.get_piece_size()
        self.pieces = {lib.id_to_piece(i) for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        #: every ending of a piece, and the sizes of the pieces that it ends with, the longest first
        self.ends: dict[str, tuple[int, ...]] = {}
        for e in sorted({p[k:] for p in self.pieces for k in range(len(p))}, key=len):
            self.ends[e] = (len(e),) * (e in self.pieces) + self.ends.get(e[1:], ())
        assert not any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) and p.strip(MARK) for p in self.pieces), "segments aren't independent in this model"
        self.known: dict[str, bytes | list[int]] = {}
        self.older: dict[str, bytes | list[int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _stays(self, a: str, b: str) -> bool:
        """Whether the library leaves the two pieces a and b as they are, side by side."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > 4 * REMEMBERED:
                self.pairs.clear()
            whole = a + b
            if whole.startswith(MARK):
                pieces = self.library.encode(whole[1:].replace(MARK, " "), out_type=str)
                got = pieces == [a, b]
            else:  # behind a line break, which no piece contains, so nothing joins with it
                pieces = self.library.encode("\n" + whole, out_type=str)
                got = pieces[-2:] == [a, b] and len(pieces) == 4
            self.pairs[a, b] = got
        return got

    def _programs(self, segments: list[str]) -> Iterator[list[int]]:
        """For each segment, in which marks begin, the counts at its prefixes 1..len; the program goes on from the prefix shared with the one before."""
        ends, pairs = self.ends, self.pairs
        counts, last, before = [0], [""], ""
        for s in segments:
            k = 0
            for x, y in zip(before, s):  # noqa: B905
                if x != y:
                    break
                k += 1
            del counts[k + 1 :], last[k + 1 :]
            for i in range(k + 1, len(s) + 1):
                sizes, j = (), i - 1
                while j >= 0 and (got := ends.get(s[j:i])) is not None:
                    sizes, j = got, j - 1
                for n in sizes:
                    t = s[i - n : i]
                    if not (a := last[i - n]) or ((ok := pairs.get((a, t))) is None and self._stays(a, t)) or ok:
                        counts.append(counts[i - n] + 1)
                        last.append(t)
                        break
                else:
                    counts.append(counts[-1] + len(s[i - 1].encode()))
                    last.append("")
            before = s
            yield counts[1:]

    def learn(self, texts: list[str | None]) -> None:
        """Remember the counts at the prefixes of all segments of these texts: the program's, where the library agrees at the end.

        New segments run through the program in sorted order, and the library encodes each once, as a check.
        """
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new: set[str] = set()
        for text in texts:
            if text:
                new.update(SEGMENT.findall(" " + text.replace(MARK, " ")))
        new -= known.keys()
        known.update((s, older[s]) for s in new if s in older)
        ask = sorted(new - known.keys())
        checks = self.library.encode([s[1:] for s in ask], num_threads=1)
        for s, ids, counts in zip(ask, checks, self._programs([s.replace(" ", MARK) for s in ask]), strict=True):
            if counts[-1] != len(ids) and s != " ":
                counts = [1 if i == 1 else len(self.library.encode(s[1:i])) for i in range(1, len(s) + 1)]
            try:
                known[s] = bytes(counts)
            except ValueError:  # over 255
                known[s] = counts

    def segments(self, text: str) -> list[bytes | list[int]]:
        """Counts at the prefixes of each segment of a text, in order; its segments must be known."""
        known = self.known
        return [known[s] for s in SEGMENT.findall(" " + text.replace(MARK, " "))]

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Counts at the prefixes of 0..len(text) code points."""
        if not text:
            return np.zeros(1, np.int32)
        self.learn([text])
        parts, base = [], 0
        for counts in self.segments(text):
            parts.append((np.frombuffer(counts, np.uint8) if isinstance(counts, bytes) else np.array(counts)).astype(np.int32) + base)
            base += int(counts[-1])
        out = np.concatenate(parts)
        out[0] = 0
        return out

    def totals(self, texts: list[str | None]) -> list[int]:
        """The count at the last prefix of each text: the program's last state of every segment, added up."""
        self.learn(texts)
        return [sum([counts[-1] for counts in self.segments(t)]) if t else 0 for t in texts]


@cache
def counter(model: str) -> PrefixCounter:
    """One for each worker process."""
    return PrefixCounter(model)


def prefix_table(docs: DataFrame, model: str | None = None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns and prefix_tokens: element i is the token count of the text's first i code points."""
    model = model or default_model()
    return map_texts(docs, keep, text_col, lambda texts: [[counter(model).prefix_counts(t) for t in texts]], "prefix_tokens array<int>")


def truncate_at(prefix_tokens: Column, budget: int) -> Column:
    """The most code points whose prefix has at most ``budget`` tokens.

    Counts can fall when a character completes a longer piece; the longest prefix that fits counts.
    """
    fits = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i).otherwise(-1))
    return F.array_max(fits)


def fits(prefix_tokens: Column, budget: int) -> Column:
    return F.element_at(prefix_tokens, -1) <= budget


def count_tokens(docs: DataFrame, limit: int = 4096, model: str | None = None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns, n_bytes, n_tokens and over_limit for every whole text; one pass, nothing is shuffled."""
    model = model or default_model()

    def run(texts: list) -> list:
        return [[len((t or "").encode()) for t in texts], counter(model).totals(texts)]

    return map_texts(docs, keep, text_col, run, "n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
