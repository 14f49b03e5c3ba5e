"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is escaped as SentencePiece does (a space becomes U+2581, one stands before the text) and cut
into the pieces whose scores add up to the most.  The search runs over the text once.  Scores are kept for
the boundaries within the longest piece, and backpointers for those since the last commit.  Where all of
the paths that may still win meet on one boundary, the ids up to there are final and leave the window.
Where no piece holds U+2581 after another character, every path meets at the start of a word, so the search
begins anew there, and what it found for a word is remembered.

The pieces are those of the public model of 32,000 pieces.  Its scores were made for merges: the ids here are
the exact best sum of scores, not the merges' order, and the public encoder's own ids differ from them.
Normalisation is the model's: it names the identity, keeps all white space, and puts one space first.

Characters without a piece of their own are written as byte pieces, and so is U+2581 itself, so
decoding gives every text back.  A control character that is in no longer piece parts words, too.

Defined results: null gives null ids and null text; the empty text gives no ids; very long texts are searched
whole (memory grows with the stretch on which paths do not meet, a word of the longest piece's length or so in
practice); equal scores take the longer last piece; repeated rows are encoded each; ids out of range raise an
error; columns of ``docs`` that bear the name of the new column are renamed; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import plain_columns, table

#: U+2581, which stands for a space.
SPACE = "▁"
#: What a character costs that only byte pieces can write, below the lowest score of the model.
BYTE_PENALTY = 10.0
#: Longer words are searched anew each time; so many words are remembered before the memory is emptied.
MEMO_CHARS, MEMO_WORDS = 48, 1_000_000
#: Rows handled at a time.
ROWS = 256
#: What follows a piece that begins no longer one.
LEAF: dict[str, tuple] = {}


class Pieces:
    """A model's pieces and scores, as read from its file."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: dict[int, int], size: int) -> None:
        self.scores = {text: (score, number) for number, text, score in pieces}
        self.byte_ids = byte_ids
        self.longest = max((len(p) for p in self.scores), default=1)
        self.worst = min((s for s, _ in self.scores.values() if s > -1e8), default=0.0) - BYTE_PENALTY
        # A tree by characters: what may follow, and the score and ids of a piece that ends here (none: minus infinity).
        self.tree: dict[str, tuple] = {}
        for text in sorted(self.scores, key=len, reverse=True):
            self._plant(text)
        for c, (more, own, _) in self.tree.items():
            if own == -np.inf:
                self.tree[c] = more, self.worst, self._bytes(c)
        self.bounded = not any(SPACE in p.lstrip(SPACE) for p in self.scores)
        # Control characters that are in no longer piece part the words as well.
        joined = {c for p in self.scores if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in joined)
        self.word = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        self.spelled = [b""] * size
        for number, text, _ in pieces:
            self.spelled[number] = text.replace(SPACE, " ").encode()
        for byte, number in byte_ids.items():
            self.spelled[number] = bytes([byte])
        self.memo: dict[str, bytes] = {}

    def _plant(self, text: str) -> None:
        node = self.tree
        for c in text[:-1]:
            node = node[c][0] if c in node else node.setdefault(c, ({}, -np.inf, ()))[0]
        score, number = self.scores[text]
        node[text[-1]] = node.get(text[-1], (LEAF,))[0], score, (number,)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def search(self, text: str) -> Iterator[int]:
        """Ids of the best pieces of an escaped text, yielded as soon as all paths that may still win agree on them.

        Where no piece reaches beyond a boundary, every path meets there, which is seen at once.  Where pieces overlap
        on and on, the paths of all boundaries in reach are followed back to where they meet, each time the stretch
        since the last commit has grown to the longest piece's length, and then to twice what it was.
        """
        size, longest, root, worst, none = len(text), self.longest, self.tree, self.worst, -np.inf
        # The lists begin at ``offset``; first: the last committed boundary, far: the farthest one reached, in the lists.
        offset = first = far = 0
        stop, room = longest, min(size, 4 * longest) + 1
        full = room - longest - 1 if room <= size else size  # beyond it the lists have to grow
        # Best sum, where the piece that ends at a boundary begins, and its ids.
        score, before, ids = [none] * room, [0] * room, [()] * room
        score[0] = 0.0
        for at in range(size):
            here = at - offset
            if here == far or at >= stop:
                meet = at if here == far else self._meeting(at, far + offset, first, offset, score, before)
                out, place = [], meet
                while place > first:
                    out.append(ids[place - offset])
                    place = before[place - offset]
                for x in reversed(out):
                    yield from x
                stop = meet + longest if meet > first else 2 * stop - first
                first = meet
                if first - offset > 4 * longest:
                    cut = first - offset
                    for x in (score, before, ids):
                        del x[:cut]
                    offset, here, far, full = first, here - cut, far - cut, full - cut
            if here > full:
                more = here + 2 * longest
                score += [none] * more
                before += [0] * more
                ids += [()] * more
                full += more
            own, node, end, last = score[here], root, here, 0
            for c in text[at : at + longest]:
                hit = node.get(c)
                if hit is None:
                    break
                node, s, i = hit
                end += 1
                total = own + s
                if total > score[end]:
                    score[end], before[end], ids[end], last = total, at, i, end
            if end == here:  # no piece starts with this character
                total, end = own + worst, here + 1
                if total > score[end]:
                    score[end], before[end], ids[end], last = total, at, self._bytes(text[at]), end
            if last > far:
                far = last
        # The end has one path.
        out, place = [], size
        while place > first:
            out.append(ids[place - offset])
            place = before[place - offset]
        for x in reversed(out):
            yield from x

    @staticmethod
    def _meeting(at: int, far: int, first: int, offset: int, score: list, before: list) -> int:
        """The boundary where the paths of all boundaries reached from ``at`` on meet: ``first`` at the earliest."""
        live = {b for b in range(at, far + 1) if score[b - offset] > -np.inf}
        for b in range(far, first, -1):
            if len(live) == 1:
                break
            if b in live:
                live.remove(b)
                live.add(before[b - offset])
        return live.pop()

    def forget(self) -> None:
        """Give back the memory of the words, and what Arrow holds for later: a worker idles on when its task has ended."""
        self.memo.clear()
        pa.default_memory_pool().release_unused()

    def _bytes(self, character: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in character.encode())

    def _word(self, word: str) -> bytes:
        """The search's ids of a word: its start is a boundary of every path, so they depend on the word alone."""
        ids = self.memo.get(word)
        if ids is None:
            ids = array("i", self.search(word)).tobytes()
            if len(word) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        if not text:
            return b""
        out: list[bytes] = []
        known = self.memo.get
        for k, part in enumerate(text.split(SPACE)):
            if k:
                out.append(np.array([self.byte_ids[b] for b in SPACE.encode()], np.int32).tobytes())
            escaped = (SPACE if k == 0 else "") + part.replace(" ", SPACE)
            if self.bounded:
                out += [known(w) or self._word(w) for w in self.word.findall(escaped)]
            else:
                out.append(np.fromiter(self.search(escaped), np.int32).tobytes())
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 are replaced."""
        return b"".join(map(self.spelled.__getitem__, ids))[1:].decode(errors="replace")


def load(model_file: str) -> Pieces:
    """Reads a SentencePiece model on the driver; executors get its pieces by broadcast."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    pieces, byte_ids = [], {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((i, model.id_to_piece(i), model.get_score(i)))
    return Pieces(pieces, byte_ids, model.get_piece_size())


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


def encoded(batches: Iterator[pa.RecordBatch], own: Pieces, text: str, into: str) -> Iterator[pa.RecordBatch]:
    """The rows of a task with their ids; what was remembered of its words goes when it ends."""
    try:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                ids = [None if x is None else own.encode(x) for x in part.column(text).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 if x is not None else 0 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(x for x in ids if x is not None), np.int32))
                lists = pa.ListArray.from_arrays(
                    pa.array(ends), values, mask=pa.array([x is None for x in ids], pa.bool_())
                )
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, into])
    finally:
        own.forget()


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", into: str = "__ids") -> DataFrame:
    """``docs`` with the ids of each whole text in a new column, an array of integers."""
    model = docs.sparkSession.sparkContext.broadcast(pieces)
    docs = plain_columns(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(batches, model.value, text, into)

    return docs.mapInArrow(run, _schema(docs, f"`{into}` array<int>"))


def decode(docs: DataFrame, pieces: Pieces, ids: str = "__ids", into: str = "__text") -> DataFrame:
    """``docs`` with the text of each row's ids in a new column."""
    model = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Pieces = model.value
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                texts = []
                for x in part.column(ids):
                    texts.append(own.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None)
                out = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, into])

    return docs.mapInArrow(run, _schema(docs, f"`{into}` string"))


def default_model() -> str:
    """Path of the 32,000-piece model among the public tokenizers of this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    pieces = load(model_file or default_model())
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decode(encode(docs, pieces), pieces).select(
        "doc_id",
        F.size("__ids").cast("long").alias("n_ids"),
        F.xxhash64("__ids").alias("ids_hash"),
        F.col("__text").eqNullSafe(F.col("text")).alias("round_trip"),
    )
