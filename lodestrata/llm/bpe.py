"""Byte-level BPE encoding and decoding by a dynamic program over prefixes.

Of every prefix of a pre-token exactly one token ends the encoding.  An automaton over the
vocabulary lists the tokens that are suffixes of each prefix; the one whose pair with the unique last
token of what stands before it is compatible (merging never joins or crosses their boundary) is
stored, and following the stored tokens back from the end gives the exact ids.  Work is linear in the
length of a pre-token, however long, where merging in rank order is not.

Scale: a map over rows without a shuffle.  The vocabulary (its size is fixed by the tokenizer file)
is sent to the executors once; results of pre-tokens are remembered in two generations of bounded
size, which changes speed only.  Texts are walked in runs of pre-tokens, so ids of one very long text
are the most that is held.

Defined cases: a null or empty text has no ids and decodes to the empty text; strings of special
tokens inside a text become their ids, as the tokenizers library does by default; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents

TOKENIZER = "byte_bpe_50k.json"
#: Remembered pre-tokens and pairs of one generation.
REMEMBER = 200_000
_NEVER = 1 << 60

#: The public pre-token pattern of byte-level BPE, with its classes named.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{l}{n}]+|[{S}]+(?![^{S}])|[{S}]+"
#: The code points with the property White_Space; the first eight are below U+0250.
_WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LATIN = 0x250


def _latin_pattern() -> re.Pattern:
    """The pattern for texts below U+0250, for the standard library's faster engine."""
    kinds = {"L": "", "N": ""}
    for c in map(chr, range(_LATIN)):
        k = unicodedata.category(c)[0]
        if k in kinds:
            kinds[k] += c
    white = _WHITE.split(" ")[0]
    return re.compile(_PATTERN.format(L=f"[{kinds['L']}]", N=f"[{kinds['N']}]", S=white, l=kinds["L"], n=kinds["N"]))


def _full_pattern():
    import regex

    return regex.compile(_PATTERN.format(L=r"\p{L}", N=r"\p{N}", S=_WHITE, l=r"\p{L}", n=r"\p{N}"))


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE tokenizer, made from the JSON of its file."""

    def __init__(self, source: str):
        import ahocorasick

        spec = json.loads(source)
        model = spec["model"]
        pre, dec = spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or dec.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files are supported")
        symbols = byte_symbols()
        text_of = {t: bytes(symbols[c] for c in t) for t in model["vocab"]}
        self.specials = {}
        for t in spec.get("added_tokens") or []:
            if t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
                raise ValueError("special tokens with trimming are not supported")
            self.specials[t["content"]] = t["id"]
        self.bytes_of: list[bytes] = [b""] * (max([*model["vocab"].values(), *self.specials.values()]) + 1)
        for t, i in model["vocab"].items():
            self.bytes_of[i] = text_of[t]
        for t, i in self.specials.items():
            self.bytes_of[i] = t.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for t, i in model["vocab"].items():
            if len(text_of[t]) == 1:
                self.born[i] = -1
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, made = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.rank[left, right] = r
            if made not in self.born:
                if left not in self.born or right not in self.born:
                    raise ValueError("the merges aren't in the order of training")
                self.born[made], self.parts[made] = r, (left, right)
        self.byte_id = {self.bytes_of[i]: i for i, b in self.born.items() if b < 0}
        self.automaton = ahocorasick.Automaton()
        for i in self.born:
            if self._is_own_encoding(i):
                text = self.bytes_of[i].decode("latin-1")
                self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.latin, self.full = _latin_pattern(), _full_pattern()
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.old_units: dict[str, bytes] = {}
        white = [c for c in map(chr, range(0x3001)) if self.full.fullmatch(c) and re.fullmatch(f"[{_WHITE}]", c)]
        self.white = [(c, c + " ", " " + c) for c in white]

    def _is_own_encoding(self, token: int) -> bool:
        """Whether the token's bytes encode to it alone: so its two parts', and nothing crosses them first."""
        if token not in self.parts:
            return True
        left, right = self.parts[token]
        return self._is_own_encoding(left) and self._is_own_encoding(right) and self._apart(left, right, self.born[token])

    def _apart(self, left: int, right: int, until: int) -> bool:
        """Whether merging keeps left and right apart while ranks below `until` are merged.

        Seen from the bytes at the boundary, each side grows through its nested tokens.  A token ends
        when its parent on its side is made; a merge of the two that meet happens if its rank comes
        before both ends.  Equal ranks are merged from the left, so the left side's own merge wins and
        the right side's loses.
        """
        inner_left, inner_right = [left], [right]
        while inner_left[-1] in self.parts:
            inner_left.append(self.parts[inner_left[-1]][1])
        while inner_right[-1] in self.parts:
            inner_right.append(self.parts[inner_right[-1]][0])
        while True:
            x, y = inner_left[-1], inner_right[-1]
            end_x = self.born[inner_left[-2]] if len(inner_left) > 1 else until
            end_y = self.born[inner_right[-2]] if len(inner_right) > 1 else until
            met = self.rank.get((x, y), _NEVER)
            if met < end_x and met <= end_y and met < until:
                return False
            if len(inner_left) == len(inner_right) == 1:
                return True
            if len(inner_left) > 1 and (end_x <= end_y or len(inner_right) == 1):
                inner_left.pop()
            else:
                inner_right.pop()

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens together encode to just the two."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 4 * REMEMBER:
                self.pairs = {}
            known = self.pairs[key] = self._apart(left, right, _NEVER)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        last = [-1] * (len(piece) + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - size
                if not start:
                    last[end] = token
                elif last[start] >= 0:
                    known = pairs.get(last[start] << 32 | token)
                    if compatible(last[start], token) if known is None else known:
                        last[end] = token
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return ids[::-1]

    def _remember(self, piece: str, found: bytes) -> bytes:
        if len(self.young) >= REMEMBER:
            self.old, self.young = self.young, {}
        if len(piece) < 100:
            self.young[piece] = found
        return found

    def _packed(self, piece: str) -> bytes:
        found = self.young.get(piece)
        if found is None:
            found = self.old.get(piece)
            found = self._remember(piece, array("I", self.encode_piece(piece.encode())).tobytes() if found is None else found)
        return found

    def _packed_unit(self, unit: str) -> bytes:
        """The ids of a space and the characters up to the next one."""
        found = self.old_units.get(unit)
        if found is None:
            found = b"".join(map(self._packed, self._pattern(unit).findall(" " + unit)))
        if len(self.units) >= REMEMBER:
            self.old_units, self.units = self.units, {}
        if len(unit) < 100:
            self.units[unit] = found
        return found

    def _pattern(self, part: str):
        return self.latin if part.isascii() or max(part) < chr(_LATIN) else self.full

    def encode_runs(self, text: str, run: int = 100_000) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, run by run."""
        for part in self.split.split(text) if self.split else [text]:
            if part in self.specials:
                yield array("I", [self.specials[part]]).tobytes()
            elif part and len(part) < 1_000_000 and part[-1] != " " and not any(c in part and (a in part or b in part) for c, a, b in self.white):
                # a single space between other characters always begins a pre-token, so what stands
                # between two of them is encoded, and remembered, by itself
                units = part.split(" ")
                if units[0]:
                    yield b"".join(map(self._packed, self._pattern(units[0]).findall(units[0])))
                known, made = self.units.get, self._packed_unit
                yield b"".join([known(u) or made(u) for u in units[1:]])
            elif part:
                pieces = (m[0] for m in self._pattern(part).finditer(part))
                while some := list(islice(pieces, run)):
                    yield b"".join(map(self._packed, some))

    def encode(self, text: str) -> list[int]:
        ids = array("I")
        for run in self.encode_runs(text):
            ids.frombytes(run)
        return ids.tolist()

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """Special tokens are kept; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_MADE: dict[str, Bpe] = {}


def _tokenizer(source: str) -> Bpe:
    """Made once in each worker process."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _MADE:
        _MADE[key] = Bpe(source)
    return _MADE[key]


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _sent(spark: SparkSession, path: str | None):
    with open(path or _default_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _texts(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) of each text; path: the tokenizer's JSON file."""
    source = _sent(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(source.value)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of doc_id, ids; null ids decode to the empty text."""
    source = _sent(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(source.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded, and its ids decoded, run
    by run; the ids themselves stay where they are made."""
    source = _sent(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(source.value)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                partial = codecs.getincrementaldecoder("utf-8")("replace")
                for ids in bpe.encode_runs(text or ""):
                    a.update(ids)
                    n += len(ids) // 4
                    b.update(partial.decode(bpe.decode_bytes(array("I", ids))).encode())
                b.update(partial.decode(b"", True).encode())
                counts.append(n)
                of_ids.append(a.hexdigest())
                of_text.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [x.split()[0] for x in _DIGESTS.split(", ")])

    return _texts(docs).mapInArrow(run, _DIGESTS)


def token_counter(spark: SparkSession, path: str | None = None):
    """A function for tasks, to be called once in each, that makes one which says how many tokens a
    text has; ids are counted run by run and not kept."""
    source = _sent(spark, path)

    def make():
        bpe = _tokenizer(source.value)
        return lambda text: sum(len(ids) // 4 for ids in bpe.encode_runs(text))

    return make


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(documents(spark, sf_dir))
