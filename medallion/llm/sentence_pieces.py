"""SentencePiece ids of whole texts for merge-type vocabularies, and texts of ids.

Adjacent symbols whose union is a piece wait in an agenda ordered by the piece's score, then by place.  The best
pair is merged and its new neighbours join the agenda; pairs whose symbols have changed since are passed over.

A text is first cut before every run of word marks, where no piece of the vocabulary can join both sides; so pairs
on the two sides never meet, and the agenda of each cut stands alone.  A vocabulary with such a piece is used on whole
texts.  Cuts met before are looked up.  Each Arrow batch ends with a check: the sentencepiece library encodes every
cut the batch brought for the first time (or, if asked, every whole text) and decodes its ids.
"""

from __future__ import annotations

import codecs
import heapq
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, text_of

#: The library's word mark.
MARK = "▁"
#: Cuts kept per Python worker, and the longest one that is kept.  Results don't depend on them.
CACHE_CUTS, CACHE_LENGTH = 1_000_000, 64
#: Cuts the library reads at once.
CHECK_CUTS = 2_000
#: ``ModelProto.SentencePiece.Type`` and the merge type of ``TrainerSpec`` (fixed values of the file format).
UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 2, 3, 4, 5, 6
MERGE_MODEL = 2
REPLACEMENT = "�"
#: Stands for a control piece until bytes are put together: no text, but bytes on its two sides are no character.
BREAK = "\udc00"

_LOADED: dict[str, PieceModel] = {}


def default_path() -> str:
    """The BPE model with byte fallback of the installed collection of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Vocabulary, agenda and caches of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rules, pieces = proto.normalizer_spec, list(proto.pieces)
        if proto.trainer_spec.model_type != MERGE_MODEL:
            raise ValueError(f"{path} is not a merge-type model")
        if proto.trainer_spec.treat_whitespace_as_suffix or not rules.escape_whitespaces or any(p.type == USER_DEFINED for p in pieces):
            raise ValueError(f"{path}: word marks as suffixes, plain white space and user-defined pieces are not supported")
        self.library = SentencePieceProcessor(model_file=path)
        self.plain = rules.add_dummy_prefix and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
        self.normalizer = None if self.plain else SentencePieceNormalizer(model_file=path)
        self.ids = {p.piece: i for i, p in enumerate(pieces) if p.type not in (UNKNOWN, CONTROL, BYTE)}
        self.scores = {p.piece: p.score for p in pieces if p.type not in (UNKNOWN, CONTROL, BYTE)}
        self.unused = {p.piece for p in pieces if p.type == UNUSED}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE} if proto.trainer_spec.byte_fallback else {}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
        self.surfaces = [p.piece.replace(MARK, " ") for p in pieces]
        for i, p in enumerate(pieces):
            if p.type == CONTROL:
                self.surfaces[i] = BREAK
            elif p.type == BYTE:  # bytes that need others stand as lone surrogates until all are together
                byte = int(p.piece[3:5], 16)
                self.surfaces[i] = chr(byte if byte < 128 else 0xDC00 + byte)
        self.surfaces[self.unknown] = proto.trainer_spec.unk_surface
        self.marked = {i for p, i in self.ids.items() if p.startswith(MARK)} if rules.add_dummy_prefix or rules.remove_extra_whitespaces else set()
        levels = sorted({-s for s in self.scores.values()})
        place = {s: i for i, s in enumerate(levels)}
        self.ranks = {p: place[-s] for p, s in self.scores.items()}
        self.joined = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pattern = re.compile(self._cut_pattern())
        # The check puts cuts into one text, which is right if each begins where nothing can join.
        self.cuts = self.plain and not any(j[1] == MARK != j[0] for j in self.joined)
        self.lines = self.cuts and not any("\n" in j for j in self.joined)
        self.known: dict[str, bytes] = {"": b""}
        self.unchecked: dict[str, bytes] = {}

    def _cut_pattern(self) -> str:
        """Cuts: marks with what follows, up to a change between letters and the characters that no piece joins with them."""
        others = {c for p in self.ids for c in p if not c.isalpha() and c != MARK} | set("\n\r\t")
        while True:
            loose = {c for a, b in self.joined for c in (a, b) if c in others and MARK not in (a, b) and not (a in others and b in others)}
            if not loose:
                break
            others -= loose
        if any(b == MARK != a for a, b in self.joined):
            return "(?s).+"
        apart = re.escape("".join(sorted(others)))
        return f"{MARK}+(?:[^{apart}{MARK}]+|[{apart}]+)?|[{apart}]+|[^{apart}{MARK}]+"

    def split(self, text: str) -> list[str]:
        """The normalized text, cut where merges cannot cross."""
        if not text:
            return []
        if self.lines and "  " not in text and text[0] != " " and MARK not in text:  # single spaces: each begins a cut
            return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")
        normal = MARK + text.replace(" ", MARK) if self.plain else self.normalizer.normalize(text)
        return self.pattern.findall(normal)

    def merge(self, cut: str) -> list[str]:
        """Pieces of one cut by the agenda.

        A symbol is the range from its first character to ``ends`` of it.  An agenda entry is one number: rank of the
        score, left symbol, end of the right one; with the left symbol and that end, its two symbols are given.
        """
        n, ranks = len(cut), self.ranks
        if n == 1:
            return [cut]
        bits = n.bit_length()
        low, ends, before = (1 << bits) - 1, list(range(1, n + 1)), list(range(-1, n - 1))
        parts: dict[str, tuple[str, str]] = {}  # what a piece that may not be used was merged from
        rank_of = ranks.get
        agenda = [(rank << bits | i) << bits | i + 2 for i in range(n - 1) if (rank := rank_of(cut[i:i + 2])) is not None]
        heapq.heapify(agenda)
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            key = pop(agenda)
            end, left = key & low, key >> bits & low
            right = ends[left]  # 0: the symbol is part of another by now
            if not right or right == n or ends[right] != end:
                continue
            if self.unused and cut[left:end] in self.unused:
                parts[cut[left:end]] = (cut[left:right], cut[right:end])
            ends[left], ends[right] = end, 0
            if end < n:
                before[end] = left
                if (rank := rank_of(cut[left:ends[end]])) is not None:
                    push(agenda, (rank << bits | left) << bits | ends[end])
            first = before[left]
            if first >= 0:
                if (rank := rank_of(cut[first:end])) is not None:
                    push(agenda, (rank << bits | first) << bits | end)
        pieces, at = [], 0
        while at < n:
            pieces.append(cut[at:ends[at]])
            at = ends[at]
        return [p for piece in pieces for p in self._usable(piece, parts)] if parts else pieces

    def _usable(self, piece: str, parts: dict[str, tuple[str, str]]) -> Iterator[str]:
        waiting = [piece]
        while waiting:
            piece = waiting.pop()
            if piece in self.unused and piece in parts:
                waiting += reversed(parts[piece])
            else:
                yield piece

    def encode_cut(self, cut: str) -> bytes:
        """Little-endian 32-bit ids; characters without a piece are their bytes, or an unknown id."""
        found = self.known.get(cut)
        if found is None:
            smaller = self.pattern.findall(cut)
            if len(smaller) > 1:
                found = b"".join(map(self.encode_cut, smaller))
            else:
                found = self.unchecked[cut] = self._encode_new(cut)
            if len(cut) <= CACHE_LENGTH:
                if len(self.known) >= CACHE_CUTS:
                    self.known = {"": b""}
                self.known[cut] = found
        return found

    def _encode_new(self, cut: str) -> bytes:
        ids, at = array("i"), 0
        for i in range(1, len(cut) + 1):
            if i < len(cut) and cut[i - 1:i + 1] in self.joined:
                continue
            for piece in self.merge(cut[at:i]):
                known = self.ids.get(piece)
                if known is not None:
                    ids.append(known)
                elif self.byte_ids:
                    ids.extend(map(self.byte_ids.__getitem__, piece.encode()))
                else:
                    ids.append(self.unknown)
            at = i
        return np.array(ids, "<i4").tobytes() if sys.byteorder != "little" else ids.tobytes()

    def encode_cuts(self, cuts: list[str]) -> np.ndarray:
        """Ids of a whole text; a run of unknown characters is one id, as in the library."""
        ids = np.frombuffer(b"".join(map(self.encode_cut, cuts)), "<i4")
        if not self.byte_ids and len(ids):
            ids = ids[~((ids == self.unknown) & np.append(False, ids[:-1] == self.unknown))]
        return ids

    def encode(self, text: str | None) -> list[int]:
        return self.encode_cuts(self.split(text or "")).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of any ids that begin a text: the mark that encoding put in front goes."""
        text = "".join(map(self.surfaces.__getitem__, ids))
        try:
            text.encode()
        except UnicodeEncodeError:
            text = "".join(_from_bytes(part.encode("utf-8", "surrogateescape")) for part in text.split(BREAK))
        first = next((i for i in ids if self.surfaces[i] != BREAK), None)
        return text[1:] if first in self.marked else text

    def check(self) -> set[str]:
        """Cuts encoded since the last check on which the library disagrees.

        The library reads them as words of one text per ``CHECK_CUTS``; only where that differs, one by one.
        """
        cuts, self.unchecked = list(self.unchecked.items()), {}
        wrong: set[str] = set()
        for at in range(0, len(cuts) if self.cuts else 0, CHECK_CUTS):
            some = cuts[at:at + CHECK_CUTS]
            if not self._library_agrees(some):
                wrong |= {c[0] for c in some if not self._library_agrees([c])}
        return wrong

    def _library_agrees(self, cuts: list[tuple[str, bytes]]) -> bool:
        """A mark is put before cuts that have none, unless their first letter joins it; those are checked in whole texts."""
        text, own = [], []
        for cut, ids in cuts:
            if cut[0] == MARK:
                text.append(cut)
                own.append(ids)
            elif MARK + cut[0] not in self.joined:
                text.append(MARK + cut)
                own += (np.array([self.ids.get(MARK, self.unknown)], "<i4").tobytes(), ids)
            elif not self._checked_behind(cut, ids):
                return False
        joined = "".join(text)
        if not joined:
            return True
        # The library puts the first mark itself.
        theirs = self.library.encode(joined[1:].replace(MARK, " "), num_threads=1) if joined != MARK else None
        if theirs is None:
            return b"".join(own) == np.array([self.ids[MARK]], "<i4").tobytes()
        return b"".join(own) == np.array(theirs, "<i4").tobytes() and self.library.decode(theirs) == self.decode(theirs)

    def _checked_behind(self, cut: str, ids: bytes) -> bool:
        """A cut that may not follow a mark follows a newline, which joins nothing."""
        theirs = self.library.encode("\n" + cut.replace(MARK, " "), num_threads=1)
        front = self.library.encode("\n", num_threads=1)
        return theirs[:len(front)] == front and ids == np.array(theirs[len(front):], "<i4").tobytes()


def _one_byte(error: UnicodeError) -> tuple[str, int]:
    return REPLACEMENT, error.start + 1


codecs.register_error("one-replacement-a-byte", _one_byte)


def _from_bytes(raw: bytes) -> str:
    """UTF-8 text; as in the library, every byte that begins no character is one replacement character."""
    return raw.decode(errors="one-replacement-a-byte")


def loaded(path: str) -> PieceModel:
    """One per Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def encode_documents(
    df: DataFrame, keep: list[str], text: str = "text", model: str | None = None, whole: bool = False,
) -> DataFrame:
    """Columns ``c0``, ``c1``, ... (those of ``keep``), ``ids``, ``decoded`` (the text of the ids) and ``agrees``.

    ``agrees`` is the library's word on the row: its cuts, or with ``whole`` (or a model whose texts can't be cut) the
    whole text, have the library's ids and decoded text.  No shuffle; a task holds one group of texts.

    Null text: as empty, so no ids and the empty text.  Null keys, repeated rows: rows as any other.  Empty table: no
    rows.  A long text is alone in its group; a cut of n characters takes n log n steps.  Other columns are not
    read, and kept ones may have any name.
    """
    path = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        compare_whole = whole or not pieces.cuts
        for batch in batches:
            for own in groups(batch, "text"):
                texts = own.column("text").to_pylist()
                cuts = [pieces.split(t) for t in texts]
                found = [pieces.encode_cuts(c) for c in cuts]
                lists = [f.tolist() for f in found]
                decoded = [pieces.decode(ids) for ids in lists]
                wrong = pieces.check()
                agrees = [not wrong or wrong.isdisjoint(s for cut in c for s in pieces.pattern.findall(cut)) for c in cuts]
                if compare_whole:
                    theirs = pieces.library.encode(texts, num_threads=1)
                    agrees = [a and ids == t and d == pieces.library.decode(t)
                              for a, ids, d, t in zip(agrees, lists, decoded, theirs, strict=True)]
                offsets = np.cumsum([0, *map(len, found)], dtype="i4")
                ids = pa.ListArray.from_arrays(offsets, np.concatenate([*found, np.empty(0, "<i4")]))
                fields = [own.schema.field(i) for i in range(own.num_columns - 1)]
                fields += [pa.field("ids", ids.type), pa.field("decoded", pa.string()), pa.field("agrees", pa.bool_())]
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:-1], ids, pa.array(decoded, pa.string()), pa.array(agrees)], schema=pa.schema(fields))

    narrow = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), text_of(df, text).alias("text"))
    kept = [f"c{i} {narrow.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep))]
    return narrow.mapInArrow(run, ", ".join([*kept, "ids array<int>", "decoded string", "agrees boolean"]))
