"""Encoding and decoding by a byte-level BPE vocabulary through a table of distinct words.

1. Tasks cut their texts into words, block by block. A word ends only where the vocabulary's own splitting certainly does,
   so a text's ids are its words' ids, one after the other. A block is one row: its documents, the numbers of the words at
   all positions, and its distinct words, dealt to buckets by their hash. Blocks are written bucketed by their number.
2. Buckets of words are brought together from all blocks and sorted: each distinct word is encoded once, by the tokenizers
   library, however many blocks have it.
3. Words' ids go back to their blocks, which stay where they are. A join from ids to pieces decodes the block's words; then
   both ids and pieces are put in the words' positions.

What is moved is each block's distinct words, there and back, many to a row; texts and positions are not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.shingles import buffers, hashed_spans
from tessera.llm.tables import kept, release_memory, table, text_blocks
from tessera.session import shared_dir

#: Bytes of text in a block (a longer text is a block of its own), and of those that are cut into words at a time.
BLOCK_BYTES, STEP_BYTES = 24_000_000, 2_000_000
#: Buckets of words to each shuffle partition.
BUCKETS = 8
_LETTER, _DIGIT, _MARK = 1, 2, 3
#: Of each byte the kind of its character; 0 where the byte alone doesn't tell.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _MARK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
#: Characters beyond ASCII (and ASCII's own separators) after which a space may belong to the same run.
_SPACES = [chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
_LAST = {len(e): [x.encode() for x in _SPACES if len(x.encode()) == len(e)] for e in (x.encode() for x in _SPACES)}
#: Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


class Words:
    """A byte-level tokenizer with the GPT-2 pattern of words and no normaliser, and where its words certainly end."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.normalizer is not None:
            raise ValueError("a normaliser may look across words")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def bounds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word of each text begins and ends; together a text's words are the text.

        A word begins where white space begins, and where the kind of character changes among ASCII letters and those of
        Latin-1, digits, and other ASCII marks, but not after an apostrophe (it may begin a contraction) and not within an
        added token. Next to other characters only white space divides.
        """
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = _KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        space = _SPACE[data]
        begins = np.zeros(len(data) + 1, bool)
        before, after = kind[:-1], kind[1:]
        begins[1:-1] = (before != after) & (before > 0) & (after > 0) & (data[:-1] != 39)
        runs = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        odd = runs[(data[runs - 1] >= 0x80) | (data[runs - 1] < 32)]
        begins[runs] = True
        for at in odd.tolist():
            if any(bytes(data[max(0, at - n) : at]) in ends for n, ends in _LAST.items()):
                begins[at] = False
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                begins[at + 1 : at + len(token)] = False
                at = raw.find(token, at + 1)
        begins[offsets] = True
        begins[-1] = False
        starts = np.flatnonzero(begins)
        return starts, np.r_[starts[1:], len(data)]

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the bytes of each id of the vocabulary, in hex; as many rows as the vocabulary has ids."""
    tokenizer = Tokenizer.from_file(path)
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    rows = [(i, added[i].encode().hex() if i in added else bytes(map(_BYTE_OF.__getitem__, word)).hex()) for word, i in tokenizer.get_vocab(True).items()]
    return spark.createDataFrame(sorted(rows), "id int, piece string")


def join_pieces(rows: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """keys, ids and `decoded` (binary): the pieces of each row's ids (array<int>), joined by id, put together by position.

    keys tell the rows apart. Ids that the vocabulary lacks give no bytes, as in the library; without ids decoded is empty.
    """
    each = rows.select(*keys, F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(known), "id", "left")
    found = F.expr("array_sort(array_agg(struct(at, id)) FILTER (WHERE id IS NOT NULL))").alias("found")
    bytes_ = F.expr("coalesce(unhex(listagg(piece) WITHIN GROUP (ORDER BY at)), X'')").alias("decoded")
    return each.groupBy(*keys).agg(found, bytes_).select(*keys, F.col("found.id").alias("ids"), "decoded")


def decode_documents(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per row of encoded (doc_id, ids array<int>): doc_id, decoded. Null or no ids give the empty text.

    The bytes of the ids' pieces, one after the other; bytes that are no UTF-8 become U+FFFD.
    """
    known = pieces(encoded.sparkSession, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    keyed = encoded.select(F.struct(F.monotonically_increasing_id().alias("n"), F.col("doc_id").cast("long").alias("doc_id")).alias("row"), "ids")
    return join_pieces(keyed, ["row"], known).select("row.doc_id", F.expr("make_valid_utf8(cast(decoded AS string))").alias("decoded"))


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, byte plane by byte plane; so they compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _of_planes(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(4, -1).T).view("<u4").ravel()


def _packed(lengths: np.ndarray, values: bytes) -> bytes:
    """Lists in one compressed string: their lengths, and all values."""
    return np.array([len(lengths), len(values)], "<u4").tobytes() + pa.compress(_planes(lengths) + values, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins and the last ends, and all values as bytes."""
    n, size = np.frombuffer(data, "<u4", 2).tolist()
    body = np.frombuffer(pa.decompress(data[8:], 4 * n + size, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.r_[0, np.cumsum(_of_planes(body[: 4 * n]), dtype=np.int64)], body[4 * n :]


class _Block:
    """The documents of a block so far, its distinct words and their positions."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.codes: dict[bytes, int] = {}
        self.bucket_of: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.docs: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, batch: pa.RecordBatch, words: Words) -> None:
        data, offsets = buffers(batch.column("text"))
        starts, ends = words.bounds(data, offsets)
        hashes = hashed_spans(data, starts, ends, hashes=2)
        order = np.argsort(hashes[0], kind="stable")
        some = hashes[:, order]
        fresh = np.r_[True, (some[:, 1:] != some[:, :-1]).any(0)] if len(order) else np.zeros(0, bool)
        raw, first, known = data.tobytes(), order[fresh], len(self.codes)
        code = np.fromiter((self.codes.setdefault(raw[a:b], len(self.codes)) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)), np.uint32, len(first))
        new, at = np.unique(code, return_index=True)
        self.bucket_of.append((hashes[0, first[at[new >= known]]] % np.uint64(self.buckets)).astype(np.int32))
        place = np.empty(len(order), np.uint32)
        place[order] = code[np.cumsum(fresh) - 1]
        self.places.append(place)
        self.docs.append(batch.column("doc_id"))
        self.counts.append(np.diff(np.searchsorted(starts, offsets)))
        self.bytes += len(data)

    def row(self, block: int) -> pa.RecordBatch:
        """Words are numbered by bucket, within it in order."""
        words, bucket = list(self.codes), np.concatenate(self.bucket_of)
        order = np.fromiter(sorted(range(len(words)), key=words.__getitem__), np.int64, len(words))
        order = order[np.argsort(bucket[order], kind="stable")]
        number = np.empty(len(words), np.uint32)
        number[order] = np.arange(len(words), dtype=np.uint32)
        bucket, words = bucket[order], [words[i] for i in order.tolist()]
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(words) else np.zeros(1, np.int64)
        held = [{"bucket": int(bucket[a]), "words": _packed(np.fromiter(map(len, words[a:b]), np.uint32, b - a), b"".join(words[a:b]))} for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        docs = pa.concat_arrays(self.docs)
        columns = [
            pa.array([block], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
            pa.array([np.concatenate(self.counts)], pa.list_(pa.int64())),
            pa.array([_packed(np.zeros(0), b"") if not len(words) else _packed(number[np.concatenate(self.places)], b"")], pa.binary()),
            pa.array([held], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "docs", "counts", "places", "held"])


def word_blocks(docs: DataFrame, path: str, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, docs (ids), counts (words of each), places (numbers of all words), held (bucket, words: its distinct words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = kept(Words, path), _Block(buckets)
        number = TaskContext.get().partitionId() << 32
        for batch in text_blocks(batches, chars=min(STEP_BYTES, block_bytes)):
            block.add(batch, words)
            if block.bytes >= block_bytes:
                yield block.row(number)
                block, number = _Block(buckets), number + 1
        if block.docs:
            yield block.row(number)
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "block long, docs array<long>, counts array<long>, places binary, held array<struct<bucket: int, words: binary>>")


def _bucketed(blocks: DataFrame) -> DataFrame:
    """blocks, written to the shared folder in buckets by block and read again; joins by block don't move them."""
    spark = blocks.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(buckets, "block").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry only: the files stay, and with them the frame
    return out


def encoded_words(held: DataFrame, path: str) -> DataFrame:
    """held (block, bucket, words) with ids in place of words.

    A bucket's rows come together and one after the other; what is remembered of a bucket are its distinct words, each of
    which is encoded once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, now, known = kept(Words, path), None, {}
        for batch in batches:
            out = []
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("words"), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                at, raw = _unpacked(data.as_py())
                raw, at = raw.tobytes(), at.tolist()
                words = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                new = [w for w in words if w not in known]
                known.update(zip(new, (np.array(ids, "<u4").tobytes() for ids in words_.encode([w.decode() for w in new])), strict=True))
                ids = list(map(known.__getitem__, words))
                out.append(_packed(np.fromiter(map(len, ids), np.uint32, len(ids)) // 4, _planes(np.frombuffer(b"".join(ids), "<u4"))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "ids"])

    return held.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "block long, bucket int, ids binary")


def _gathered(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the items in `which`, one after the other, and where each begins; item i has those from at[i] to at[i + 1]."""
    lengths = np.diff(at)[which]
    upto = np.r_[0, np.cumsum(lengths)]
    return values[np.repeat(at[:-1][which] - upto[:-1], lengths) + np.arange(upto[-1])], upto


def _placed(pieces_: tuple[np.ndarray, np.ndarray]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Gives a block's documents the ids of their words, by position, and the pieces of the ids: every id meets its piece."""

    def run(blocks: pa.Table, words: pa.Table) -> pa.Table:
        release_memory()
        parts: list[pa.Table] = [_ENCODED.empty_table()]
        order = np.argsort(words.column("bucket").to_numpy())
        lists = [_unpacked(words.column("ids")[i].as_py()) for i in order.tolist()]
        flat = np.concatenate([np.zeros(0, "<u4"), *(_of_planes(values) for _, values in lists)])
        id_at = np.r_[0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(at) for at, _ in lists)]))]
        raw, piece_at = _gathered(*pieces_, flat.astype(np.int64))
        text_at = piece_at[id_at]
        for row in range(blocks.num_rows):
            docs, counts = blocks.column("docs")[row].values, blocks.column("counts")[row].values.to_numpy()
            places = np.diff(_unpacked(blocks.column("places")[row].as_py())[0])
            bounds = np.r_[0, np.cumsum(counts)]
            cuts = np.unique(np.r_[0, np.searchsorted(bounds, np.arange(1 << 19, bounds[-1], 1 << 19)), len(counts)])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # about so many words at a time
                which, own = places[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                (some, upto), (text, text_upto) = _gathered(flat, id_at, which), _gathered(raw, text_at, which)
                packed = [pa.Array.from_buffers(kind, b - a, [None, pa.py_buffer(at[own].astype(np.int32)), pa.py_buffer(values)]) for kind, at, values in ((pa.binary(), 4 * upto, some), (pa.string(), text_upto, text))]
                parts.append(pa.Table.from_arrays([docs[a:b], *packed], schema=_ENCODED))
        return pa.concat_tables(parts)

    return run


def encode_documents(docs: DataFrame, tokenizer: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, ids (little-endian unsigned 32-bit integers), decoded (the text that the ids give).

    The ids are those of the tokenizers library without special tokens added; an added token's own text in a document is
    that token. tokenizer: the file of a byte-level BPE without a normaliser. A null text counts as empty: no ids, decoded
    empty. Rows may repeat, ids may be null; an empty table gives an empty result. Other columns are not looked at.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _bucketed(word_blocks(docs, path, buckets, block_bytes))
    words = encoded_words(blocks.select("block", F.inline("held")), path)
    known = [bytes.fromhex(r.piece) for r in pieces(docs.sparkSession, path).orderBy("id").collect()]  # dense: row i is id i
    table_ = np.frombuffer(b"".join(known), np.uint8), np.r_[0, np.cumsum([len(x) for x in known])]
    return blocks.select("block", "docs", "counts", "places").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_placed(table_), "doc_id long, ids binary, decoded string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents"))
    size = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", size.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
