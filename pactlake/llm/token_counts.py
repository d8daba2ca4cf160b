"""Token counts of a byte-pair tokenizer by merging with a heap over a linked list; no identifiers are made.

The symbols of a word start as its characters in a linked list. A heap holds every adjacent pair whose
concatenation is a piece, by rank (ties: the leftmost); the lowest is popped and merged, which may put two new
pairs on the heap, until none is left. Each merge takes one symbol away, so the count is that of the initial
symbols less the merges. A character outside the vocabulary counts as its UTF-8 bytes (byte fallback).

A merged symbol is always a piece, so no merge crosses two characters that stand side by side in no piece. The
vocabulary is asked whether a blank ever follows another character inside a piece, and which signs follow a letter
in none; the text falls apart there into parts that are merged by themselves. Counts of words and parts up to
CACHED_CHARS are kept in two tables of at most CACHED_WORDS entries for each Python worker, emptied when full; longer
ones are merged each time, in n log n steps, so one huge word or text is no more than a long loop over its length.

Model: a SentencePiece BPE file with byte pieces and without user-defined or unused pieces; the driver reads it
once (at most MODEL_BYTES) and tasks get its bytes. Normalisation is the library's own for that file.

Null and empty texts have no bytes and no tokens. Rows stand for themselves: repeated rows give repeated results,
null ids stay null, ties do not arise. Special strings (<s>, <unk>, <0x41>) are ordinary text. Other columns are
ignored, whatever their names. An empty table gives none.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLANK = "▁"
LIMIT = 4096
CACHED_WORDS, CACHED_CHARS = 1 << 19, 64
MODEL_BYTES = 16 << 20


class Remembered(dict):
    """Values of a function of a word; at most `most` of them are kept, and none of long words."""

    def __init__(self, function: Callable[[str], int], most: int):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, word: str) -> int:
        found = self.function(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


class Merger:
    """Counts tokens with the pieces of one model."""

    def __init__(self, model: bytes, cached_words: int = CACHED_WORDS):
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(processor.get_piece_size())
        if not any(processor.is_byte(i) for i in ids) or any(processor.is_unused(i) for i in ids):
            raise ValueError("the model must have byte pieces and no unused ones")
        normal = [i for i in ids if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))]
        self.rank = {processor.id_to_piece(i): -processor.get_score(i) for i in normal}
        self.single = frozenset(c for c in self.rank if len(c) == 1)
        pattern = self.word_pattern()
        self.parts = re.compile(pattern).findall
        self.falls_apart = BLANK in pattern
        self.normalize = sentencepiece.SentencePieceNormalizer(model_proto=model).normalize
        self.of_part = Remembered(self.merged, cached_words)
        self.of_word = Remembered(lambda word: sum(map(self.of_part.__getitem__, self.parts(BLANK + word))), cached_words)

    def word_pattern(self) -> str:
        """Cuts a text before runs of blanks, and between letters and the signs that follow a letter in no piece."""
        pairs = {(a, b) for piece in self.rank for a, b in zip(piece, piece[1:], strict=False)}
        if any(b == BLANK and a != BLANK for a, b in pairs):
            return "(?s).+"
        letters = {c for c in self.single if c.isalpha()}
        signs = {c for c in map(chr, range(128)) if not c.isalpha()} - {b for a, b in pairs if a in letters}
        some = lambda cs: "".join(map(re.escape, sorted(cs)))
        return f"{BLANK}*+[{some(letters)}]++(?![^{BLANK}{some(signs)}])|{BLANK}+[^{BLANK}]*|[^{BLANK}]+"

    def merged(self, word: str) -> int:
        """Tokens of one word."""
        rank, n = self.rank, len(word)
        symbols: list[str | None] = list(word)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank[pair], i, pair) for i in range(n - 1) if (pair := word[i : i + 2]) in rank]
        heapq.heapify(heap)
        count = n
        if not self.single.issuperset(word):  # symbols that are no piece count as their bytes
            count += sum(len(c.encode()) - 1 for c in word if c not in self.single)
        while heap:
            _, left, pair = heapq.heappop(heap)
            right = after[left]
            if symbols[left] is None or right < 0 or symbols[left] + symbols[right] != pair:
                continue  # one of the two has been merged since
            count -= 1
            for side in (symbols[left], symbols[right]):
                if side not in rank:
                    count -= len(side.encode()) - 1
            symbols[left], symbols[right] = pair, None
            beyond = after[left] = after[right]
            if beyond >= 0:
                before[beyond] = left
                if (wider := pair + symbols[beyond]) in rank:
                    heapq.heappush(heap, (rank[wider], left, wider))
            if (ahead := before[left]) >= 0 and (wider := symbols[ahead] + pair) in rank:
                heapq.heappush(heap, (rank[wider], ahead, wider))
        return count

    def count(self, text: str | None) -> int:
        """Tokens of a text; null has none."""
        text = self.normalize(text) if text else ""
        if self.falls_apart and text[:1] == BLANK and text[-1:] != BLANK and 2 * BLANK not in text:
            return sum(map(self.of_word.__getitem__, text[1:].split(BLANK)))
        return sum(map(self.of_part.__getitem__, self.parts(text)))


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        model = f.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"the tokenizer model is larger than {MODEL_BYTES} bytes")
    return model


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row."""
    model = model_bytes(path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [merger.count(t) for t in texts]
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return rows.mapInArrow(counted, schema)
