"""SentencePiece encoding and decoding (operator 12): exact merge-type (BPE) encoding by backtracking.

A sequence of pieces is what merging gives for a text if and only if, for each two neighbours, merging their joined
characters gives these two again: the first merge across a border would already happen with the two pieces alone. So a
text has one such sequence, and so has each of its prefixes. The encoder looks for it from left to right. It takes the
longest piece at each position (from an Aho-Corasick automaton over the reversed pieces, which reads the text once), goes
to the next shorter piece while it and its predecessor don't belong together, and steps back where none is left. A
position from which nothing leads on is marked in a bitfield and never tried again; as a prefix has one encoding only,
the position says it all, and the work is linear in the text.

Texts are cut where no piece of the vocabulary reaches across: before a space that follows another character, at
ASCII characters that no piece joins to others, and before marks that no piece joins to a word character. The ids of short words and the verdicts on neighbours are kept at hand in each Python
worker, up to a fixed number. Characters that no piece has become their UTF-8 bytes' pieces.

Defined results: a null text counts as the empty text (begin and end ids alone); repeated rows each give a row; a null
doc_id stays null; very long texts and words are encoded whole; merges of equal score go from left to right, as in the
library; an empty table gives an empty result; extra columns are ignored, whatever their names. Models of another
type, or with a normalizer, user-defined or unused pieces, are refused.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pretokens

SPACE = "▁"
#: Bounds of what a worker keeps at hand.
WORDS, PAIRS, SHORT = 500_000, 300_000, 48
BLOCK, JOINED = 1 << 18, 1 << 15


class Codec:
    """Encoder and decoder of one sentencepiece model of merge type."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model

        spec = model.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds = model.ModelProto.SentencePiece
        rules = spec.normalizer_spec
        if spec.trainer_spec.model_type != model.TrainerSpec.BPE or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} is not of merge type")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not rules.add_dummy_prefix:
            raise ValueError(f"{path} has a normalizer")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError(f"{path} has user-defined or unused pieces")
        self.score = {p.piece: p.score for p in spec.pieces if p.type == kinds.NORMAL}
        ids = {p.piece: k for k, p in enumerate(spec.pieces)}
        self.numbers = {p: ids[p] for p in self.score}
        self.bytes = [ids.get(f"<0x{b:02X}>", spec.trainer_spec.unk_id) for b in range(256)]
        self.begin, self.end = spec.trainer_spec.bos_id, spec.trainer_spec.eos_id
        self.pairs = _Pairs(self.merged)
        self.words: dict[str, bytes] = {}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.score)
        if any("\0" in p for p in self.score):
            raise ValueError(f"{path} has a piece with a null character")
        joined = set().union(*(p for p in self.score if len(p) > 1))
        alone = _class(chr(c) for c in range(128) if chr(c) not in joined)
        after = {p[k] for p in self.score for k in range(1, len(p)) if re.match(r"\w", p[k - 1])}
        marks = _class(chr(c) for c in range(128) if re.match(r"\W", chr(c)) and chr(c) not in after)
        word = f"{SPACE}*\\w++(?=[{marks}])|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+"
        self.cut = re.compile(f"[{alone}]|" + (f"[^{alone}]+" if inner else word), re.S).findall
        self.gap = re.compile("(?!)" if inner else f"(?<=[^{SPACE}]){SPACE}").search
        self.pieces = [b"" if p.type == kinds.CONTROL else spec.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode() for p in spec.pieces]
        self.is_byte = [p.type == kinds.BYTE for p in spec.pieces]
        self.spaced = [p.type == kinds.NORMAL and p.piece[:1] == SPACE for p in spec.pieces]

    @functools.cached_property
    def ids(self) -> dict[str, int]:
        """Pieces that can be in an encoding: one that merging doesn't give for its own characters never is."""
        return {p: k for p, k in self.numbers.items() if len(p) == 1 or self.merged(p) == [p]}

    @functools.cached_property
    def shorter(self) -> dict[str, str | None]:
        return {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), None) for p in self.ids}

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for p in self.ids:
            made.add_word(p[::-1], p)
        made.make_automaton()
        return made

    def merged(self, text: str) -> list[str]:
        """Pieces by merging: the pair of the best score first, the leftmost of equals. For short texts."""
        parts, score = list(text), self.score.get
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def backtracked(self, text: str) -> list[str]:
        """The encoding of a text; a character that no piece has stands for itself, and nothing is joined across it."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, piece in self.automaton.iter(text[::-1]):  # of the pieces that end at a place, the longest comes first
            if longest[end] is None:
                longest[end] = piece
        longest.reverse()
        longest.append(None)
        failed = bytearray((n >> 3) + 1)
        out: list[str] = []
        shorter, pairs = self.shorter, self.pairs
        at, last, piece = 0, "", longest[0]
        while at < n:
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (not last or pairs[last, piece]):
                    break
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                at, last = end, piece
                piece = longest[at]
            elif longest[at] is None:
                out.append(text[at])
                at, last = at + 1, ""
                piece = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                out.pop()
                at, piece, last = at - len(last), shorter[last], out[-1] if out else ""
                if last not in shorter:
                    last = ""
        return out

    def packed(self, pieces: list[str]) -> bytes:
        try:
            return array("I", map(self.ids.__getitem__, pieces)).tobytes()
        except KeyError:
            return array("I", [k for p in pieces for k in ([self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()])]).tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode words that aren't at hand, many at a time: joined by a character that no piece has."""
        new, size = [], 0
        for w in words:
            new.append(w)
            size += len(w)
            if size > JOINED:
                self._learn(new)
                new, size = [], 0
        if new:
            self._learn(new)

    def _learn(self, words: list[str]) -> None:
        pieces = self.backtracked("\0".join(words))
        pieces.append("\0")
        at, known, packed = 0, self.words, self.packed
        for w in words:
            end = pieces.index("\0", at)
            known[w] = packed(pieces[at:end])
            at = end + 1

    def encode(self, text: str) -> bytes:
        """Ids of a whole text with begin and end, packed as unsigned 32-bit numbers of this machine's (little) order."""
        out = [array("I", [self.begin]).tobytes()]
        known = self.words
        for block in self.blocks(SPACE + text.replace(" ", SPACE)) if text else ():
            words = self.cut(block)
            if len(known) > WORDS:
                known.clear()
            new = set(words).difference(known)
            long = {w for w in new if len(w) > SHORT or "\0" in w}
            self.learn(new - long if long else new)
            out += map(known.__getitem__, words) if not long else (self.packed(self.backtracked(w)) if w in long else known[w] for w in words)
        out.append(array("I", [self.end]).tobytes())
        return b"".join(out)

    def blocks(self, text: str) -> Iterator[str]:
        """Parts of about BLOCK characters, cut only where a text may be cut."""
        at = 0
        while len(text) - at > BLOCK and (m := self.gap(text, at + BLOCK)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def decode(self, ids: bytes) -> str:
        """The text of packed ids: control pieces say nothing, and the space before the first piece goes."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        parts = list(map(self.pieces.__getitem__, numbers))
        first = next((k for k, p in enumerate(parts) if p), None)
        if first is not None and self.spaced[numbers[first]]:
            parts[first] = parts[first][1:]
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:  # byte pieces that are no characters
            return "".join(self._lenient(numbers, parts))

    def _lenient(self, numbers: list[int], parts: list[bytes]) -> Iterator[str]:
        run = bytearray()
        for k, p in zip([*numbers, -1], [*parts, b""], strict=True):
            if k >= 0 and self.is_byte[k]:
                run += p
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        c = run[:n].decode()
                        break
                    except UnicodeDecodeError:
                        c, n = "�", 1 if n == 4 else n
                yield c
                del run[:n]
            yield p.decode()


class _Pairs(dict):
    """For two pieces, whether merging the characters of both gives these two again."""

    def __init__(self, merged: Callable[[str], list[str]]):
        super().__init__()
        self.merged = merged

    def __missing__(self, pair: tuple[str, str]) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        a, b = pair
        known = self[pair] = self.merged(a + b) == [a, b]
        return known


def _class(characters: Iterator[str]) -> str:
    """The inside of a character class; a surrogate stands for nothing, as no text has one."""
    return re.escape("".join(characters)) or "\\ud800"


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_tokens, ids (packed little-endian unsigned 32-bit numbers, begin and end among them)."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary"
    arrow = common.to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path).encode
        for batch in batches:
            for part in common.slices(batch):
                ids = list(map(of, common.texts_of(part)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], schema=arrow)

    return common.map_arrow(docs, run, schema).withColumnRenamed("doc_id", id_col)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds the column ``decoded``, the text of the packed ``ids``, to what ``encode`` returns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded string"
    arrow = common.to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path).decode
        for batch in batches:
            for part in common.slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(of, part.column("ids").to_pylist()), pa.string())], schema=arrow)

    return common.map_arrow(encoded, run, schema)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with begin and end ids, and decoded again: digests of the ids and of the text."""
    path = pretokens.default_path("piece_bpe_32k.model")
    docs = decode(encode(common.load(spark, sf_dir, "documents"), path), path)
    return docs.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
