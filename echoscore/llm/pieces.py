"""SentencePiece merge-type encoding by backtracking, and decoding.

The library merges the best-scored adjacent pair again and again. The same ids come from matching: at each place take the longest
piece (an Aho-Corasick automaton over the vocabulary finds all), accept it if it is compatible with the piece
before it, that is, if merging the two pieces' characters anew gives these two pieces, else try the next shorter one; with
none left, mark the place as failed in a bit field and go back by one piece. A place is entered once, so the
work is linear. A sequence whose neighbours are all compatible is the one that merging gives.

Texts are cut where no piece can reach across: before a run of word marks, around characters that are in no piece, and between
characters that are neighbours in none. Words repeat: each different stretch between spaces of a batch is encoded once and
its ids and surface are gathered; results of short ones are kept in the worker, within a bound.

NULL and empty texts have no ids and decode to ''. Rows are neither merged nor lost; whole texts are encoded.
One pass, no shuffle. Each task reads the vocabulary file, whose path must be valid on the executors.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from echoscore.llm.words import pieces as text_pieces, text_bytes
from echoscore.llm.worker import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
KEPT, KEPT_LENGTH, PAIRS = 200_000, 48, 1_000_000


class Pieces:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str | None = None):
        import ahocorasick
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, size = self.library, self.library.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.id = {names[i]: i for i in plain}
        self.shown = {i: names[i].replace(MARK, " ") for i in plain} | {i: "" for i in range(size) if lib.is_control(i)}
        self.marked = {i for i in plain if names[i].startswith(MARK)}
        self.shown |= {i: " ⁇ " for i in range(size) if lib.is_unknown(i)}
        self.rank = {names[i]: -lib.get_score(i) for i in plain}
        self.bytes = {i: int(names[i][3:-1], 16) for i in range(size) if lib.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.characters = {c for p in self.id for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.id) or len(self.byte_id) != 256:
            raise ValueError("needs a vocabulary with byte fallback whose pieces hold word marks at their start only")
        # Pieces that merging never builds can't be part of a result.
        reached = [p for p in self.id if self._merged(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in reached:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        known = "".join(map(re.escape, sorted(self.characters - {MARK})))
        self.cut = re.compile(f"{MARK}*[{known}]+|{MARK}+|.", re.DOTALL)
        # two characters that are neighbours in no piece are never merged across
        self.joints = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        # the same as a bit matrix over numbered characters; 0 is any other one, a space is a word mark
        self.number = np.zeros(0x110000, np.int64)
        ordered = sorted(self.characters | {MARK})
        self.number[[ord(c) for c in ordered]] = np.arange(1, len(ordered) + 1)
        self.number[0x20] = self.number[ord(MARK)]
        self.n_characters = len(ordered) + 1
        left, right = (self.number[[ord(j[k]) for j in self.joints]] for k in (0, 1))
        bits = np.zeros(self.n_characters**2, bool)
        bits[left * self.n_characters + right] = True
        self.joined = np.packbits(bits)
        self.pairs: dict[str, dict[str, bool]] = {}
        self.count = 0
        self.kept: dict[str, tuple[list[int], str]] = {}
        self.older: dict[str, tuple[list[int], str]] = {}

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging itself."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get(parts[k] + parts[k + 1], float("inf")))
            joined = parts[best] + parts[best + 1]
            if joined not in self.rank:
                break
            parts[best : best + 2] = [joined]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both gives them back; remembered in ``pairs``."""
        if self.count >= PAIRS:
            self.pairs.clear()
            self.count = 0
        self.count += 1
        answer = self._merged(left + right) == [left, right]
        self.pairs.setdefault(left, {})[right] = answer
        return answer

    def _matched(self, text: str) -> list[int]:
        """Backtracking over the matches in a text without inner cuts."""
        if len(text) == 1 and text not in self.characters:
            return [self.byte_id[b] for b in text.encode()]
        starts: list[list[str]] = [[] for _ in text]
        for end, piece in self.automaton.iter(text):
            starts[end + 1 - len(piece)].append(piece)  # shorter ones come first: they end earlier
        chosen: list[str] = []
        tried: list[int] = []  # the next shorter piece at each place
        failed, at, stop = 0, 0, len(text)
        k = len(starts[0]) - 1
        answers: dict[str, bool] = {}
        while at < stop:
            options = starts[at]
            while k >= 0:
                piece = options[k]
                k -= 1
                if failed and failed >> (at + len(piece)) & 1:
                    continue
                if chosen:
                    answer = answers.get(piece)
                    if answer is None:
                        answer = self._compatible(chosen[-1], piece)
                        answers = self.pairs[chosen[-1]]
                    if not answer:
                        continue
                chosen.append(piece)
                tried.append(k)
                at += len(piece)
                k = len(starts[at]) - 1 if at < stop else -1
                break
            else:
                failed |= 1 << at
                at -= len(chosen.pop())
                k = tried.pop()
            if chosen:
                answers = self.pairs.get(chosen[-1], {})
        return [self.id[p] for p in chosen]

    def _segment(self, text: str) -> tuple[list[int], str]:
        """Ids and surface, from the kept results if there are any."""
        found = self.kept.get(text) or self.older.get(text)
        if found is None:
            inner = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.joints]
            if inner:
                parts = [self._segment(text[a:b]) for a, b in zip([0, *inner], [*inner, len(text)])]
                found = [i for ids, _ in parts for i in ids], "".join(shown for _, shown in parts)
            else:
                ids = self._matched(text)
                found = ids, self.decode_pieces(ids)
        if len(text) <= KEPT_LENGTH:
            self._keep(text, found)
        return found

    def normalized(self, text: str) -> str:
        return (MARK + text.replace(" ", MARK)) if text else ""

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids of a text, and the text they decode to."""
        ids, shown = self._stretch(self.normalized(text))
        return ids, shown[1:]

    def _stretch(self, text: str) -> tuple[list[int], str]:
        ids: list[int] = []
        shown: list[str] = []
        for segment in self.cut.findall(text):
            found = self.kept.get(segment) or self._segment(segment)
            ids += found[0]
            shown.append(found[1])
        return ids, "".join(shown)

    def encode_all(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids and decoded texts of a batch. Each different stretch between spaces is encoded once; the rest is gathered."""
        data, bounds = text_bytes(texts)
        filled = np.diff(bounds) > 0
        # a space before each text that is not empty
        first = np.concatenate([[0], np.cumsum(np.diff(bounds) + filled)])
        spaced = np.full(int(first[-1]), 0x20, np.uint8)
        spaced[np.arange(len(data)) + np.repeat(np.cumsum(filled), np.diff(bounds))] = data
        cut = spaced == 0x20
        cut[1:] &= spaced[:-1] != 0x20
        cut[first[:-1][filled]] = True
        # word marks that stand in a text itself join the spaces beside them: such a text stays whole
        for k in np.flatnonzero(np.asarray(pc.match_substring(texts, MARK).fill_null(False).to_numpy(zero_copy_only=False))):
            cut[first[k] + 1 : first[k + 1]] = False
        starts = np.flatnonzero(cut)
        offsets = np.append(starts, len(spaced)).astype(np.int32)
        stretches = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(spaced)).dictionary_encode()
        parts, first_part = self._parts(stretches.dictionary)
        found = [self.kept.get(part) or self._again(part) for part in parts.dictionary.to_pylist()]
        # the parts of every stretch, in order
        each = np.asarray(stretches.indices)
        n = np.diff(first_part)[each]
        ends = np.cumsum(n)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first_part[each] - (ends - n), n)
        codes = pa.array(np.asarray(parts.indices)[take])
        ids = pa.array([f[0] for f in found], pa.list_(pa.int32())).take(codes)
        shown = pa.array([f[1] for f in found], pa.string()).take(codes)
        of_text = np.concatenate([[0], ends])[np.searchsorted(starts, first)]
        at = np.asarray(ids.offsets) - ids.offsets[0].as_py()
        lists = pa.ListArray.from_arrays(pa.array(at[of_text].astype(np.int32)), ids.flatten())
        # the space that encoding puts first is taken off
        text, ends = text_bytes(shown)
        ends = ends[of_text]
        rest = np.delete(text, ends[:-1][filled])
        ends = (ends - np.concatenate([[0], np.cumsum(filled)])).astype(np.int32)
        return lists, pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rest)))

    def _parts(self, stretches: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Stretches cut between characters that are neighbours in no piece, and the first part of each (and the total)."""
        data, bounds = text_bytes(stretches)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        known = self.number[points]
        pair = known[:-1] * self.n_characters + known[1:]
        cut = np.ones(len(points), bool)
        cut[1:] = (self.joined[pair >> 3] >> (7 - (pair & 7)).astype(np.uint8)) & 1 == 0
        cut[np.searchsorted(place, bounds[:-1])] = True
        starts = place[:-1][cut]
        offsets = np.append(starts, len(data)).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        return parts, np.searchsorted(starts, bounds)

    def _again(self, part: str) -> tuple[list[int], str]:
        found = self.older.get(part)
        if found is None:
            return self._part(part)
        self._keep(part, found)
        return found

    def _part(self, part: str) -> tuple[list[int], str]:
        """Ids and surface of a part, spaces as word marks."""
        ids = self._matched(part.replace(" ", MARK))
        found = ids, self.decode_pieces(ids)
        if len(part) <= KEPT_LENGTH:
            self._keep(part, found)
        return found

    def _keep(self, text: str, found: tuple[list[int], str]) -> None:
        if len(self.kept) >= KEPT:  # what was not asked for since the last change goes
            self.older, self.kept = self.kept, {}
        self.kept[text] = found

    def decode_pieces(self, ids: list[int]) -> str:
        """Surface of the pieces, word marks as spaces. Bytes that are no UTF-8 become U+FFFD each, as in the library."""
        if self.bytes.keys().isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        out, raw = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(raw):
                for n in range(1, 5):
                    try:
                        out.append(raw[at : at + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                at += n
            raw.clear()

        for i in ids:
            if i in self.bytes:
                raw.append(self.bytes[i])
                continue
            if raw:
                flush()
            out.append(self.shown[i])
        if raw:
            flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any id list; the space that encoding puts first is taken off."""
        text = self.decode_pieces(ids)
        first = next((i for i in ids if self.shown.get(i, "?")), None)
        return text[1:] if first in self.marked else text


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>, decoded string) for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = kept(("pieces", path), lambda: Pieces(path))
        for batch in text_pieces(batches, "text", 1 << 22):
            yield pa.RecordBatch.from_arrays([batch.column("id"), *vocabulary.encode_all(batch.column("text"))], ["id", "ids", "decoded"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, "id long, ids array<int>, decoded string")
