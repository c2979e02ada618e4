"""Token counts of every prefix of a text, by dynamic programming over prefixes.

Byte-pair encoding has a property that makes this work: a list of tokens is the encoding of its bytes if every two
neighbours are the encoding of theirs. So the last token of a prefix is the longest vocabulary entry that ends there and
whose neighbour, the last token of the prefix before it, it stands next to in the encoding of the two. The count of a
prefix is one more than the count of the prefix before its last token. Words are worked out once per worker and kept;
a text's table is put together from those of its words. Truncation and budgets are then look-ups in the table.

Prefixes end at code points. A prefix may split differently from the whole text only inside its last piece: after a run
of white space that the text goes on behind, within a contraction, or within a special token; these are worked out as
the texts they are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegauge.llm.common import Kept, slices, text_or_empty, worker_state
from routegauge.llm.tokens import load_encoding
from routegauge.session import ship_package

ENTRIES = 400_000
_PAIR_ENTRIES = 1_000_000
_LONG = 32  # bytes of a piece that is worked out together with others
#: The contractions of the pre-tokenizer.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


class PrefixTable:
    """Counts of all prefixes of texts for one vocabulary."""

    def __init__(self, path: str, entries: int = ENTRIES):
        import public_tokenizers
        import regex

        encoding = load_encoding(path)
        self.special = sorted(encoding.special_tokens_set, key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokens = {t: i for t, i in encoding._mergeable_ranks.items()}
        self.bytes_of = {i: t for t, i in self.tokens.items()}
        self.steps: dict[int, int] = {}  # the vocabulary from behind: (node, byte) to node
        self.ends: list[int] = [-1]  # the token that a node spells, or -1
        for token, i in self.tokens.items():
            node = 0
            for byte in reversed(token):
                node = self.steps.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = i
        self.encode = encoding._encode_single_piece
        self.pieces = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.space = regex.compile(r"\p{White_Space}")
        self.words, self.pairs, self.step_keys = Kept(entries), Kept(_PAIR_ENTRIES), None

    def neighbours(self, left: int, right: int) -> bool:
        """Whether two tokens stand next to each other in the encoding of their bytes."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs.recall(key)
            if known is None:
                known = self.encode(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
                self.pairs.enter(key, known)
        return known

    def byte_counts(self, word: bytes) -> list[int]:
        """Counts of all byte prefixes of one piece, the empty one included.

        The vocabulary is walked backwards from each end until no entry ends like that; the longest entries are tried first.
        """
        steps, ends, neighbours, pairs = self.steps.get, self.ends, self.neighbours, self.pairs.get
        counts, last = [0], [-1]
        for end in range(1, len(word) + 1):
            node, start, found = 0, end, []
            while start:
                node = steps(node << 8 | word[start - 1])
                if node is None:
                    break
                start -= 1
                if ends[node] >= 0:
                    found.append((start, ends[node]))
            for start, token in reversed(found):
                if start == 0 or ((fits := pairs(last[start] << 20 | token)) is None and neighbours(last[start], token)) or fits:
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
        return counts

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """The nodes behind (node, byte) keys, -1 where no entry goes on."""
        if self.step_keys is None:
            order = np.argsort(found := np.fromiter(self.steps, np.int64, len(self.steps)))
            self.step_keys, self.end_of = found[order], np.array(self.ends)
            self.step_nodes = np.fromiter(self.steps.values(), np.int64, len(self.steps))[order]
        at = np.minimum(np.searchsorted(self.step_keys, keys), len(self.step_keys) - 1)
        return np.where(self.step_keys[at] == keys, self.step_nodes[at], -1)

    def byte_counts_of(self, words: list[bytes]) -> list[list[int]]:
        """``byte_counts`` of many pieces in step, end by end; the few long ones are done on their own."""
        short = sorted((i for i, w in enumerate(words) if len(w) <= _LONG), key=lambda i: -len(words[i]))
        out = [[] if len(w) <= _LONG else self.byte_counts(w) for w in words]
        if not short:
            return out
        sizes = np.array([len(words[i]) for i in short])
        width, rows = int(sizes[0]), len(short)
        codes = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in short), np.uint8).reshape(rows, width).astype(np.int64)
        counts, last = np.zeros((rows, width + 1), np.int64), np.full((rows, width + 1), -1)
        known, neighbours = self.pairs.get, self.neighbours
        for end in range(1, width + 1):
            open_rows = np.arange(int(np.searchsorted(-sizes, -end, "right")))
            node, at, found = np.zeros(len(open_rows), np.int64), open_rows, []
            for start in range(end - 1, -1, -1):
                node = self._lookup(node << 8 | codes[at, start])
                at, node = at[node >= 0], node[node >= 0]
                if not len(at):
                    break
                token = self.end_of[node]
                if (ends := token >= 0).any():
                    found.append((start, at[ends], token[ends]))
            todo = np.ones(rows, bool)
            for start, at, token in reversed(found):
                at, token = at[todo[at]], token[todo[at]]
                if start:
                    keys = (last[at, start] << 20 | token).tolist()
                    fits = [known(k) if known(k) is not None else neighbours(k >> 20, k & 0xFFFFF) for k in keys]
                    at, token = at[fits], token[fits]
                counts[at, end], last[at, end], todo[at] = counts[at, start] + 1, token, False
        for i, size, row in zip(short, sizes.tolist(), counts.tolist(), strict=True):
            out[i] = row[: size + 1]
        return out

    def prepare(self, lists: list[list[str]]) -> None:
        """Work out the pieces of several texts at once that no cache holds."""
        words = self.words
        lacking = [p for p in set().union(*lists) if p not in words and words.recall(p) is None and p not in CONTRACTIONS]
        raws = [p.encode("utf-8", "surrogatepass") for p in lacking]
        for p, raw, counts in zip(lacking, raws, self.byte_counts_of(raws), strict=True):
            words.enter(p, self._at_code_points(p, raw, counts))

    def _at_code_points(self, piece: str, raw: bytes, counts: list[int]) -> bytes:
        counts = counts[1:]
        if len(raw) != len(piece):
            counts = [n for n, after in zip(counts, raw[1:] + b"a", strict=True) if after & 0xC0 != 0x80]
        return array("i", counts).tobytes()

    def piece(self, piece: str) -> bytes:
        """Counts (32-bit) of all code point prefixes of one piece of the pre-tokenizer."""
        if piece in CONTRACTIONS:
            counts = [sum(len(self.encode(p.encode())) for p in self.pieces.findall(piece[:i])) for i in range(1, len(piece) + 1)]
        else:
            raw = piece.encode("utf-8", "surrogatepass")
            return self._at_code_points(piece, raw, self.byte_counts(raw))
        return array("i", counts).tobytes()

    def ordinary(self, text: str, pieces: list[str] | None = None) -> np.ndarray:
        """Counts of all non-empty prefixes of a text without special tokens."""
        if not text:
            return np.zeros(0, np.int64)
        pieces, words = pieces or self.pieces.findall(text), self.words
        found = list(map(words.get, pieces))
        if None in found:
            for i, value in enumerate(found):
                if value is None:
                    p = pieces[i]
                    value = words.get(p) or words.recall(p)
                    if value is None:
                        value = self.piece(p)
                        words.enter(p, value)
                    found[i] = value
        own = np.frombuffer(b"".join(found), np.int32).astype(np.int64)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ends = np.cumsum(lengths)
        totals = own[ends - 1]
        before = np.cumsum(totals) - totals
        table = own + np.repeat(before, lengths)
        for i in self._runs(pieces):  # the prefix that ends behind a run of white space has the run as one piece
            run = np.frombuffer(self.piece(pieces[i - 1] + pieces[i][0]), np.int32)[-1]
            table[ends[i - 1]] = before[i - 1] + run
        return table

    def _runs(self, pieces: list[str]) -> Iterator[int]:
        for i in [i for i, blank in enumerate(map(str.isspace, pieces), 1) if blank]:
            if i < len(pieces) and ((p := pieces[i])[0] == " " or p.isspace()) and self.space.match(p[0]):
                yield i

    def _plain(self, text: str) -> bool:
        return self.split_special is None or not any(s in text for s in self.special)

    def counts_of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """``counts`` of several texts, whose unknown pieces are worked out together."""
        lists = [self.pieces.findall(t) if self._plain(t) else [] for t in texts]
        self.prepare(lists)
        for text, pieces in zip(texts, lists, strict=True):
            yield self.ordinary(text, pieces) if pieces else self.counts(text)

    def counts(self, text: str) -> np.ndarray:
        """Counts of all non-empty prefixes; a special token's string is that token once it is complete."""
        if self._plain(text):
            return self.ordinary(text)
        out, base = [], 0
        parts = self.split_special.split(text)
        for i in range(0, len(parts), 2):
            special = parts[i + 1] if i + 1 < len(parts) else ""
            table = self.ordinary(parts[i] + special[:-1])
            own = int(table[len(parts[i]) - 1]) if parts[i] else 0
            out.append(table + base)
            base += own
            if special:
                base += 1
                out.append(np.array([base]))
        return np.concatenate(out)


def _table(path: str) -> PrefixTable:
    return worker_state(f"prefixes:{path}", lambda: PrefixTable(path))


def with_prefix_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, prefix_tokens): the token counts of all prefixes, one per code point, from the shortest to the whole text.

    Null texts count as empty and have an empty array. Texts are read whole, however long; other columns do not matter. An
    empty table gives no rows.
    """
    ship_package(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(tokenizer)
        for batch in batches:
            for row in range(0, batch.num_rows, 64):  # tables are several times as large as their texts
                part = batch.slice(row, 64)
                counts = pa.array(list(table.counts_of(part.column(1).to_pylist())), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), counts], names=["doc_id", "prefix_tokens"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(apply, "doc_id long, prefix_tokens array<int>")


def with_budgets(docs: DataFrame, tokenizer: str, budget: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, kept_chars): the count of the whole text, and the longest prefix within the budget.

    kept_chars counts code points. Both are looked up in the table of prefix counts; the text is not encoded again. Null
    texts count as empty: zero in every column. Rows that repeat get the same answer each. Texts are read whole, however long;
    other columns do not matter. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(tokenizer)
        for batch in slices(batches):
            totals, kept = [], []
            for counts in table.counts_of(batch.column(2).to_pylist()):
                within = np.flatnonzero(counts <= budget)
                totals.append(int(counts[-1]) if len(counts) else 0)
                kept.append(int(within[-1]) + 1 if len(within) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(totals, pa.int64()), pa.array(kept, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "kept_chars"],
            )

    body = text_or_empty(text)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    return rows.mapInArrow(apply, "doc_id long, n_bytes long, n_tokens long, kept_chars long")
