"""SentencePiece BPE encoding and decoding by a prefix table.

For every prefix of a chunk the table keeps the one token that ends the prefix's encoding. The candidates are the pieces
that end there (matches of an Aho-Corasick automaton); a candidate is right if the pair (last token of the prefix before
it, candidate) is compatible, i.e. the two texts together encode to just these two tokens. The ids then follow backwards
from the last prefix. Chunks are a run of word-start marks and what follows it up to the next run: no piece has a mark
after another character (checked when the model is read), so no merge crosses chunks and equal chunks are encoded once.

Cases: a null text counts as empty and has no ids; characters without a piece become byte pieces; texts of any length are
handled chunk by chunk; repeated rows and null ids are encoded as they are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType

from fairline.llm.common import small_batches, source
from fairline.llm.common import worker_cache as kept_in_worker

MARK = "▁"


class PieceModel:
    """What encoding needs: normal pieces with scores, byte pieces, the dummy prefix of the text."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        import ahocorasick

        self.text = [p for p, _, _ in pieces]
        self.kind = [k for _, _, k in pieces]
        order = sorted((-s, i, p) for i, (p, s, k) in enumerate(pieces) if k == "normal")
        self.rank = {p: r for r, (_, _, p) in enumerate(order)}  # merges with a lower rank go first
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k == "normal"}
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        if any(k in ("unused", "user") for k in self.kind) or len(self.byte) != 256:
            raise ValueError("only models with byte pieces and without unused or user-defined pieces")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id):
            raise ValueError("pieces that go on after a word end")
        alphabet = set("".join(self.id))
        alone = "".join(c for c in "\n\r\t" if c not in alphabet)  # never part of a merge
        self.chunk = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + f"|[{alone}]" * bool(alone))
        self.good: dict[str, dict[str, bool]] = {}  # by the right token, then by the left one
        self.n_good = 0
        self.spaced = [p.replace(MARK, " ") for p in self.text]
        self.decimal = [str(i) for i in range(len(pieces))]
        self.halves: dict[str, tuple[str, str]] = {}  # the two parts that a piece's last merge joins
        # pieces that merging never builds from their own text never end a prefix
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if len(p) > 1:
                if len(two := self.merged(p, stop=2)) != 2 or self.merged(p) != [p]:
                    continue
                self.halves[p] = (two[0], two[1])
            self.good[p] = {}
            self.automaton.add_word(p, (p, len(p), self.good[p]))
        self.automaton.make_automaton()

    @classmethod
    def rows(cls, path: str) -> list[tuple[str, float, str]]:
        """Pieces, scores and types of a model file; bounded by the vocabulary."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "unused" if sp.is_unused(i) else "normal"
        return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """Merging by definition, for short texts: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Do a and b, side by side, stay apart?

        Goes back in time from the finished tokens: x and y touch at the border until the merge that took one of them
        in. If joining x and y had come before that merge, the border would be gone. On equal ranks the left one wins:
        the one inside a, or else the join at the border.
        """
        known = self.good[b].get(a)
        if known is None:
            if self.n_good >= 250_000:
                for of in self.good.values():
                    of.clear()
                self.n_good = 0
            rank, halves, x, y, until = self.rank, self.halves, a, b, len(self.rank) + 1
            known = True
            while True:
                r = rank.get(x + y)
                if r is not None and r < until:
                    known = False
                    break
                left, right = halves.get(x), halves.get(y)
                if left is None and right is None:
                    break
                if right is None or left is not None and rank[x] > rank[y]:
                    until, x = rank[x], left[1]
                else:
                    until, y = rank[y] + 1, right[0]
            self.good[b][a] = known
            self.n_good += 1
        return known

    def pieces(self, chunk: str) -> list[str]:
        last: list[str] = []  # last[i]: the token that ends the prefix of i + 1 characters
        compatible, settle, settled = self.compatible, last.append, 0
        for i, found in self.automaton.iter(chunk):  # by end, longest first
            if settled > i:
                continue
            while settled < i:  # no piece fits there: a character of its own
                settle(chunk[settled])
                settled += 1
            t, size, known = found
            if size <= i:
                left = last[i - size]
                if not (known[left] if left in known else compatible(left, t)):
                    continue
            settle(t)
            settled += 1
        last += chunk[settled:]
        out, i = [], len(chunk) - 1
        while i >= 0:
            t = last[i]
            out.append(t)
            i -= len(t)
        out.reverse()
        return out

    def ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for p in self.pieces(chunk):
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def chunks(self, text: str) -> Iterator[str]:
        if not text:
            return iter(())
        marked = MARK + text.replace(" ", MARK)
        return iter(self.chunk.findall(marked)) if len(marked) <= 1 << 20 else map(itemgetter(0), self.chunk.finditer(marked))

    def written(self, chunk: str) -> tuple[str, str]:
        """Decimal ids joined by commas, and the text that the ids decode to without regard to what is before them."""
        try:
            ids = [self.id[p] for p in self.pieces(chunk)]
        except KeyError:  # a character without a piece
            ids = self.ids(chunk)
            return ",".join(map(str, ids)), self.decode(ids, first=False)
        return ",".join([self.decimal[i] for i in ids]), "".join([self.spaced[i] for i in ids])

    def encode(self, text: str | None) -> list[int]:
        return [i for c in self.chunks(text or "") for i in self.ids(c)]

    def decode(self, ids: list[int], first: bool = True) -> str:
        parts, run = [], bytearray()
        for i in ids:
            if self.kind[i] == "byte":
                run.append(int(self.text[i][3:5], 16))
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if self.kind[i] == "normal":
                parts.append(self.text[i].replace(MARK, " "))
        parts.append(run.decode("utf-8", "replace"))
        text = "".join(parts)
        return text[1:] if first and text[:1] == " " else text


class Cache(dict):
    """Chunk -> decimal ids joined by commas, and the text they decode to.

    Two generations, so memory stays bounded and what is asked for again stays: when half of the room is full, the newer
    half becomes the older one and the older one goes, but for what is looked up there before the next turn.
    """

    def __init__(self, model: PieceModel, most: int):
        super().__init__()
        self.model, self.half, self.older = model, max(1, most // 2), {}

    def __missing__(self, chunk: str) -> tuple[str, str]:
        out = self.older.get(chunk) or self.model.written(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[chunk] = out
        return out


KEPT = "pieces"  # the name under which tasks of other operators let it go
_CACHES: dict[tuple[str, int], Cache] = kept_in_worker().setdefault(KEPT, {})


def worker_cache(key: str, pieces: list[tuple[str, float, str]], most: int) -> Cache:
    """The one cache of a worker process: the next task with the same model goes on with it, another model replaces it.

    It is not looked up as a global of this module: a task may bring its own copy of the module's functions and globals.
    """
    caches = kept_in_worker().setdefault(KEPT, {})
    if (key, most) not in caches:
        caches.clear()
        caches[key, most] = Cache(PieceModel(pieces), most)
    return caches[key, most]


def encode(docs: DataFrame, model_path: str, most_cached: int = 250_000, with_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 (and ids as an array if asked for) to doc_id."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    pieces = PieceModel.rows(model_path)
    shared = spark.sparkContext.broadcast(pieces)  # bounded: the vocabulary
    key = hashlib.sha256(repr(pieces).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(key, shared.value, most_cached)
        for batch in batches:
            counts, ids_sha, text_sha, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                n, a, b, own = 0, hashlib.sha256(), hashlib.sha256(), []
                parts = cache.model.chunks(text or "")
                while some := list(map(cache.__getitem__, islice(parts, 50_000))):
                    joined = ",".join([ids for ids, _ in some])
                    a.update((("," if n else "") + joined).encode())
                    decoded = "".join([part for _, part in some])
                    b.update((decoded[1:] if not n and decoded[:1] == " " else decoded).encode("utf-8", "surrogatepass"))
                    n += joined.count(",") + 1
                    if with_ids:
                        own += map(int, joined.split(","))
                counts.append(n)
                ids_sha.append(a.hexdigest())
                text_sha.append(b.hexdigest())
                lists.append(own)
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                arrays.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    some = docs.select("doc_id", "text")
    schema = some.drop("text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    names = schema.names
    return some.mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(source(spark, sf_dir, "documents"), default_model())
