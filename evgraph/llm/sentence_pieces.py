"""SentencePiece encoding and decoding with a max-plus parallel scan for giant documents.

The encoding is the segmentation with the largest sum of piece scores (of equal ones, the one whose last piece that
differs starts first), characters outside the vocabulary fall back to bytes. Texts are cut where no piece can lie
across, and words are looked up in a cache.

A giant document goes through Spark in chunks. The state at a chunk's border is how many characters a piece that
starts before it reaches beyond it. Each chunk yields the matrix of best scores from entry to exit states; matrices
combine associatively in the (max, +) algebra, first in spans of chunks, then over a document. From its entry
scores each chunk then finds the entry state of every exit state; chaining these maps from the end fixes all states, and
each chunk is traced back on its own.
"""

import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import map_documents, worker_model
from evgraph.session import materialize

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0  # below the least score, for a character without a piece
CACHED_WORDS = 300_000
NOWHERE = float("-inf")


def read_pieces(path: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is piece, byte or other. `path` is a file that the driver can open."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = lambda i: "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece"
    return [(model.id_to_piece(i), model.get_score(i), kinds(i)) for i in range(model.get_piece_size())]


class Pieces:
    """The vocabulary as a trie over plain text: the space marker of the file is a space here."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.trie: list = [{}, None, -1]  # children, and score and id of the piece that ends here
        self.byte_ids = np.zeros(256, np.int64)
        own = [(i, p.replace("▁", " "), s) for i, (p, s, kind) in enumerate(pieces) if kind == "piece"]
        plain = [bytes([int(p[3:-1], 16)]) if kind == "byte" else p.replace("▁", " ").encode() if kind == "piece" else b"" for p, _, kind in pieces]
        self.bytes_of = pa.array(plain, pa.large_binary())
        for i, (p, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte_ids[int(p[3:-1], 16)] = i
        self.unknown = min(s for _, _, s in own) - UNKNOWN_PENALTY
        self.reach = max(len(p) for _, p, _ in own)
        for i, p, score in own:
            node = self.trie
            for c in p:
                node = node[0].setdefault(c, [{}, None, -1])
            node[1:] = score, i
        joined = {c for _, p, _ in own if len(p) > 1 for c in p}
        spaced = any(re.search("[^ ] ", p) for _, p, _ in own)
        inner = "[" + "".join(map(re.escape, sorted(joined - {" "}))) + "]" if joined - {" "} else "(?!)"
        # no piece lies across the ends of these parts
        self.parts = re.compile(f" *{inner}+| +|." if not spaced else f"(?: |{inner})+|.", re.DOTALL)
        self.splits_at_spaces, self.splits_at_lines = not spaced, "\n" not in joined
        self._parts = _Encoded(self.word)
        # by words with and without a space before them
        self._spaced = _Encoded(lambda w: b"".join(map(self.word, self.parts.findall(" " + w))))
        self._plain = _Encoded(lambda w: b"".join(map(self.word, self.parts.findall(w))))

    @classmethod
    def of(cls, key: str, pieces) -> "Pieces":
        return worker_model(("pieces", key), lambda: cls(pieces))

    def viterbi(self, text: str, entry: dict[int, float], stop: int) -> tuple[list[float], list[int], list[int]]:
        """Best scores of the places in `text` over pieces that start before `stop`, and start and id of each last piece.

        `entry` gives scores of places where a path can begin: their start is -1. Id -1 marks a character without a piece.
        """
        best = [NOWHERE] * (len(text) + 1)
        since, ids = [-1] * len(best), [-1] * len(best)
        for place, score in entry.items():
            best[place] = score
        root, reach, unknown = self.trie[0], self.reach, self.unknown
        for start in range(min(stop, len(text))):
            here = best[start]
            if here == NOWHERE:
                continue
            children, at, single = root, start, False
            for c in text[start : start + reach]:
                node = children.get(c)
                if node is None:
                    break
                at += 1
                children, score, piece = node
                if score is not None:
                    if at == start + 1:
                        single = True
                    score += here
                    if score > best[at]:
                        best[at], since[at], ids[at] = score, start, piece
            if not single and here + unknown > best[start + 1]:
                best[start + 1], since[start + 1], ids[start + 1] = here + unknown, start, -1
        return best, since, ids

    def trace(self, text: str, since: list[int], ids: list[int], place: int) -> tuple[int, bytes]:
        """Where the path to `place` begins, and its ids as little-endian 32-bit integers."""
        out: list[int] = []
        while since[place] >= 0:
            if ids[place] >= 0:
                out.append(ids[place])
            else:
                out += self.byte_ids[list(text[since[place] : place].encode())][::-1].tolist()
            place = since[place]
        return place, array("i", out[::-1]).tobytes()

    def word(self, text: str) -> bytes:
        """Ids of a part."""
        return self.trace(text, *self.viterbi(text, {0: 0.0}, len(text))[1:], len(text))[1]

    def _line(self, line: str) -> bytes:
        """Ids of characters between which and the rest of a text no piece lies."""
        if "  " in line or not self.splits_at_spaces:
            return b"".join(map(self._parts.__getitem__, self.parts.findall(line)))
        first, *rest = line.split(" ")
        return self._plain[first] + b"".join(map(self._spaced.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        """Ids of a space and the text; none for an empty or null text."""
        if not text:
            return b""
        if self.splits_at_lines:
            return self._parts["\n"].join(map(self._line, (" " + text).split("\n")))
        return self._line(" " + text)

    def decode(self, ids: np.ndarray) -> str:
        """Exactly the text that was encoded; ids that aren't of an encoding are decoded as far as they are UTF-8."""
        found = self.bytes_of.take(pa.array(ids, pa.int32()))
        text = (found.buffers()[2].to_pybytes() if len(found) and found.buffers()[2] else b"").decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class _Encoded(dict):
    """Ids by key; what is missing is encoded, and kept while there is room."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, key: str) -> bytes:
        ids = self._encode(key)
        if len(key) < 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[key] = ids
        return ids


class Chunk:
    """`size` characters of a document and up to reach - 1 more behind them."""

    def __init__(self, pieces: Pieces, text: str, size: int):
        self.pieces, self.text, self.size = pieces, text, size
        ends = [m.end() for m in pieces.parts.finditer(text[:size])][:-1]
        # the first and the last part can go on beyond the chunk
        self.head, self.tail = (ends[0], ends[-1]) if ends else (None, None)

    def _head(self, entry: dict[int, float]):
        text = self.text[: self.head]
        return text, *self.pieces.viterbi(text, {s: v for s, v in entry.items() if s <= self.head}, self.head)

    def _tail(self):
        text = self.text[self.tail :]
        return text, *self.pieces.viterbi(text, {0: 0.0}, self.size - self.tail)

    def _all(self, entry: dict[int, float]):
        return self.text, *self.pieces.viterbi(self.text, {s: v for s, v in entry.items() if s <= len(self.text)}, self.size)

    def _exits(self, best: list[float], border: int) -> np.ndarray:
        out = np.full(self.pieces.reach, NOWHERE)
        part = best[border : border + self.pieces.reach]
        out[: len(part)] = part
        return out

    def transfer(self) -> np.ndarray:
        """Best scores from each entry state (row) to each exit state (column)."""
        reach = self.pieces.reach
        if self.head is None:
            return np.array([self._exits(self._all({s: 0.0})[1], self.size) for s in range(reach)])
        enter = np.array([self._head({s: 0.0})[1][self.head] if s <= self.head else NOWHERE for s in range(reach)])
        middle = sum(
            self.pieces.viterbi(w, {0: 0.0}, len(w))[0][-1] for w in self.pieces.parts.findall(self.text[self.head : self.tail])
        )
        return enter[:, None] + middle + self._exits(self._tail()[1], self.size - self.tail)[None, :]

    def entries(self, scores: np.ndarray) -> np.ndarray:
        """The entry state of the best path to each exit state from entry states of these scores; -1: none."""
        entry = {s: float(v) for s, v in enumerate(scores) if v > NOWHERE}
        if self.head is None:
            text, best, *back = self._all(entry)
            exits = self._exits(best, self.size)
            return np.array([self.pieces.trace(text, *back, self.size + t)[0] if v > NOWHERE else -1 for t, v in enumerate(exits)])
        text, _, *back = self._head(entry)
        first = self.pieces.trace(text, *back, self.head)[0]
        return np.where(self._exits(self._tail()[1], self.size - self.tail) > NOWHERE, first, -1)

    def ids(self, scores: np.ndarray, exit_state: int) -> bytes:
        entry = {s: float(v) for s, v in enumerate(scores) if v > NOWHERE}
        if self.head is None:
            text, _, *back = self._all(entry)
            return self.pieces.trace(text, *back, self.size + exit_state)[1]
        text, _, *back = self._head(entry)
        end, _, *ending = self._tail()
        middle = b"".join(map(self.pieces._parts.__getitem__, self.pieces.parts.findall(self.text[self.head : self.tail])))
        return (
            self.pieces.trace(text, *back, self.head)[1]
            + middle
            + self.pieces.trace(end, *ending, self.size - self.tail + exit_state)[1]
        )


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., :, None] + b[None, :, :]).max(-2) if a.ndim == 2 else (a[:, None] + b).max(0)


def _start(reach: int) -> np.ndarray:
    out = np.full(reach, NOWHERE)
    out[0] = 0.0
    return out


class Encoder:
    """Encoding and decoding of tables with one vocabulary, which is sent to each executor once."""

    def __init__(self, spark, pieces: list[tuple[str, float, str]], chunk_chars: int = 16_384, span: int = 128):
        self.pieces = Pieces(pieces)
        if chunk_chars < self.pieces.reach:
            raise ValueError(f"a chunk must hold the longest piece, {self.pieces.reach} characters")
        self.chunk_chars, self.span = chunk_chars, span
        shared, key = spark.sparkContext.broadcast(pieces), str(hash(tuple(pieces)))
        self._vocabulary = lambda: Pieces.of(key, shared.value)

    def encode(self, docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        """doc_id, ids (array<int>) and the columns `carry` of every row of `docs` (doc_id, text).

        Null and empty texts have no ids; repeated rows stay; an empty table gives an empty result. Texts of more
        than four chunks go through the scan, equal ones once.
        """
        giant = F.coalesce(F.length("text") > 4 * self.chunk_chars, F.lit(False))
        columns = ["doc_id", F.col("text").cast("string").alias("text"), *carry]
        vocabulary = self._vocabulary
        small = docs.select(*columns).filter(~giant)
        kinds = dict(small.dtypes)
        fields = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *carry))

        def whole(batch):
            return batch | {"ids": _lists([vocabulary().encode(t) for t in batch["text"]])}

        plain = map_documents(small.select("doc_id", "text", *[c for c in carry if c != "text"]), whole, f"{fields}, ids array<int>")
        large = docs.select(*columns).filter(giant).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
        return plain.union(large.join(self._scan(large), "key").select("doc_id", *carry, "ids"))

    def _scan(self, large: DataFrame) -> DataFrame:
        """(key, ids) of each distinct text."""
        size, reach, span, vocabulary = self.chunk_chars, self.pieces.reach, self.span, self._vocabulary

        def cut(batches):
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = " " + text.as_py()
                    places = range(0, len(text), size)
                    yield pa.RecordBatch.from_pydict({
                        "key": [key] * len(places), "no": pa.array(range(len(places)), pa.int32()),
                        "size": pa.array([min(size, len(text) - p) for p in places], pa.int32()),
                        "text": [text[p : p + size + reach - 1] for p in places],
                        "last": [p + size >= len(text) for p in places],
                    })

        chunk_schema = "key string, no int, size int, text string, last boolean"
        chunks = materialize(
            large.select("key", "text").mapInArrow(cut, chunk_schema).dropDuplicates(["key", "no"]), "chunks"
        )

        def transfers(batch):
            made = [Chunk(vocabulary(), t, n).transfer() for t, n in zip(batch["text"], batch["size"])]
            return batch | {"matrix": [m.tobytes() for m in made], "span": [n // span for n in batch["no"]]}

        matrices = materialize(map_documents(chunks, transfers, "key string, no int, span int, matrix binary"), "transfers")
        square = lambda b: np.frombuffer(b).reshape(reach, reach)

        def combined(pdf):  # at most `span` matrices
            rows = pdf.sort_values("no")
            total = square(rows.matrix.iloc[0])
            for b in rows.matrix.iloc[1:]:
                total = max_plus(total, square(b))
            return pd.DataFrame({"key": [rows.key.iloc[0]], "span": [rows.span.iloc[0]], "matrix": [total.tobytes()]})

        def prefixes(pdf, order, scores):
            out = []
            for b in pdf.sort_values(order).matrix:
                out.append(scores.tobytes())
                scores = max_plus(scores, square(b))
            return out

        def over_document(pdf):  # one matrix for `span` chunks of one text
            return pd.DataFrame({"key": pdf.key, "span": sorted(pdf.span), "scores": prefixes(pdf, "span", _start(reach))})

        def over_span(pdf):
            return pd.DataFrame({"key": pdf.key, "no": sorted(pdf.no), "scores": prefixes(pdf, "no", np.frombuffer(pdf.scores.iloc[0]))})

        spans = matrices.groupBy("key", "span").applyInPandas(combined, "key string, span int, matrix binary")
        begun = spans.groupBy("key").applyInPandas(over_document, "key string, span int, scores binary")
        scores = matrices.join(begun, ["key", "span"]).groupBy("key", "span").applyInPandas(over_span, "key string, no int, scores binary")
        known = materialize(chunks.join(scores, ["key", "no"]), "scored_chunks")

        def entries(batch):
            made = [Chunk(vocabulary(), t, n).entries(np.frombuffer(s)) for t, n, s in zip(batch["text"], batch["size"], batch["scores"])]
            return batch | {"entry": made}

        def exits(pdf):  # a small map for each chunk of one text
            rows = pdf.sort_values("no")
            state, out = 0, []
            for entry in rows.entry.iloc[::-1]:
                out.append(state)
                state = int(entry[state])
            return pd.DataFrame({"key": rows.key, "no": rows.no, "state": out[::-1]})

        states = (
            map_documents(known, entries, "key string, no int, entry array<int>")
            .groupBy("key").applyInPandas(exits, "key string, no int, state int")
        )

        def traced(batch):
            rows = zip(batch["text"], batch["size"], batch["scores"], batch["state"])
            return batch | {"ids": _lists([Chunk(vocabulary(), t, n).ids(np.frombuffer(s), x) for t, n, s, x in rows])}

        parts = map_documents(known.join(states, ["key", "no"]), traced, "key string, no int, ids array<int>")
        return parts.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda p: p["ids"])).alias("ids"))

    def decode(self, encoded: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        """doc_id, text and the columns `carry` of every row of `encoded` (doc_id, ids); null ids give an empty text."""
        vocabulary = self._vocabulary
        kinds = dict(encoded.dtypes)
        fields = "".join(f", `{c}` {kinds[c]}" for c in carry)
        shape = encoded.sparkSession.createDataFrame([], f"doc_id {kinds['doc_id']}{fields}, text string").schema

        def run(batches):
            from pyspark.sql.pandas.types import to_arrow_schema

            schema = to_arrow_schema(shape)
            for batch in batches:
                ids = batch.column("ids")
                ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())))
                values = ids.flatten().to_numpy(zero_copy_only=False)
                texts = [vocabulary().decode(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                columns = [batch.column(c) for c in ("doc_id", *carry)] + [pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

        return encoded.select("doc_id", "ids", *[c for c in carry if c != "ids"]).mapInArrow(run, shape)


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) // 4 for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))
