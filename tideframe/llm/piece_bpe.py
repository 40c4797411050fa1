"""SentencePiece encoding and decoding for BPE models, by backtracking.

The model merges, again and again, the adjacent pair whose union has the best score. A sequence of pieces is that result
if each piece is its own encoding and each adjacent pair is the encoding of its union. So the encoder walks forward: an
Aho-Corasick automaton gives all pieces at each position, the longest is tried first, and a piece is taken if it is
compatible with the one before (checked by merging the two anew, once for each pair). A position from which no piece
leads on is marked in a bitfield and never entered again; the walk steps back. Characters without a piece become their
UTF-8 byte pieces. No piece holds a space mark after another character, nor a line break, so texts are encoded between
these, and what was encoded before is looked up.

One map over the whole texts, no shuffle. Tasks hold the model's tables and looked-up strings of at most KNOWN bytes in all;
strings over LONG characters are not kept. A long string without spaces is encoded in stretches, cut where no piece of the
model crosses: no merge can cross there either, so the ids are the same.

Defined results: null or empty text has the end id alone and decodes to an empty text; repeated rows get equal results;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tideframe.llm.shared import documents, prepare

MARK = "▁"
#: Bytes, by estimate, of the looked-up strings that a task keeps; longer strings than LONG characters are not kept.
KNOWN, LONG, ENTRY = 256 << 20, 256, 350
#: Characters without a space that are encoded at once, if a cut is among them; otherwise twice as many, and so on.
STRETCH = 1 << 12
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceBpe:
    """Tables of one model file: pieces, scores, and the automaton over its normal pieces."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)  # read for its vocabulary alone
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_id)}
        self.end = sp.eos_id()
        self.silent = {i for i in range(n) if sp.is_control(i)}
        normal = [i for i in range(n) if not (i in self.silent or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any("\n" in self.pieces[i] or MARK in self.pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("pieces that cross line breaks or hold inner space marks are not supported")
        self.id_of = {self.pieces[i]: i for i in normal}
        self.score = [sp.get_score(i) for i in range(n)]
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i))
        self.automaton.make_automaton()
        self.alone: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.longest = max(len(self.pieces[i]) for i in normal)
        self.held = 0
        self.prefixed: dict[str, tuple[str, str]] = {}
        self.bare: dict[str, tuple[str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """The merge procedure itself, for short strings."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.id_of.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, a: int) -> bool:
        if (ok := self.alone.get(a)) is None:
            ok = self.alone[a] = len(self.merged(self.pieces[a])) == 1
        return ok

    def fits(self, a: int, b: int) -> bool:
        if (ok := self.pairs.get((a, b))) is None:
            ok = self.pairs[a, b] = self.merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        return ok

    def segment(self, text: str) -> list[int]:
        """Ids of a string that no piece leaves or enters, in stretches that no piece leaves or enters."""
        out: list[int] = []
        at, size = 0, STRETCH
        while len(text) - at > size:
            if cut := self._cut(text, at, at + size):
                out += self._stretch(text[at:cut])
                at, size = cut, STRETCH
            else:
                size *= 2
        return out + self._stretch(text[at:])

    def _cut(self, text: str, first: int, last: int) -> int:
        """The last position after ``first``, up to ``last``, that no piece crosses; 0 if pieces cross them all."""
        crossed = bytearray(last + self.longest - first)
        for end, (size, _) in self.automaton.iter(text[first : last + self.longest]):
            crossed[end - size + 2 : end + 1] = b"\1" * (size - 1)
        cut = crossed.rfind(b"\0", 1, last - first + 1)
        return first + cut if cut > 0 else 0

    def _stretch(self, text: str) -> list[int]:
        n = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, (size, i) in self.automaton.iter(text):
            starts[last - size + 1].append((size, i))
        out: list[int] = []
        at = 0
        while at < n:
            if not starts[at]:
                out += [self.byte_id[b] for b in text[at].encode()]
                at += 1
                continue
            stop = at + 1
            while stop < n and starts[stop]:
                stop += 1
            # characters with a piece end here or at one without; matches never cross such a character
            out += self._walk(starts, at, stop)
            at = stop
        return out

    def _walk(self, starts: list[list[tuple[int, int]]], first: int, stop: int) -> list[int]:
        failed = 0
        path: list[tuple[int, int, int]] = []  # position, number of the choice there, piece
        at, choice = first, 0
        while at < stop:
            options = starts[at]
            if choice == 0 and len(options) > 1:
                options.sort(reverse=True)
            before = path[-1][2] if path else -1
            while choice < len(options):
                size, i = options[choice]
                if not failed >> (at + size - first) & 1 and self.whole(i) and (before < 0 or self.fits(before, i)):
                    break
                choice += 1
            if choice < len(options):
                path.append((at, choice, options[choice][1]))
                at, choice = at + options[choice][0], 0
            elif path:
                failed |= 1 << (at - first)
                at, choice, _ = path.pop()
                choice += 1
            else:
                raise ValueError("no encoding")
        return [i for _, _, i in path]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; a single leading space is the encoder's own and goes."""
        text = self.spell(ids)
        return text[1:] if text.startswith(" ") else text

    def spell(self, ids: list[int]) -> str:
        out, raw = [], b""
        for i in ids:
            if i in self.byte_of:
                raw += self.byte_of[i]
                continue
            if raw:
                out.append(_utf8(raw))
                raw = b""
            if i not in self.silent:
                out.append(self.pieces[i])
        if raw:
            out.append(_utf8(raw))
        return "".join(out).replace(MARK, " ")

    def _known(self, store: dict[str, tuple[str, str]], word: str, text: str) -> tuple[str, str]:
        ids = [i for x in _SEGMENT.findall(text) for i in self.segment(x)]
        got = (" ".join(map(str, ids)), self.spell(ids))
        if len(word) <= LONG:
            if self.held >= KNOWN:
                self.prefixed.clear()
                self.bare.clear()
                self.held = 0
            self.held += ENTRY + len(got[0]) + 8 * len(word)
            store[word] = got
        return got

    def encode(self, text: str) -> tuple[str, str]:
        """(ids as decimals joined by spaces, what they decode to) of a whole text with the end id."""
        text = text.replace(MARK, " ")
        ids: list[str] = []
        out: list[str] = []
        prefixed, bare = self.prefixed, self.bare
        line_break = str(self.byte_id[10])
        for k, line in enumerate(text.split("\n")) if text else ():
            if k:
                ids.append(line_break)
                out.append("\n")
                if not line:
                    continue
            if "  " in line or line[:1] == " " or line[-1:] == " " or not line:
                whole = MARK * (not k) + line.replace(" ", MARK)
                for x in _SEGMENT.findall(whole):
                    a, b = bare.get(x) or self._known(bare, x, x)
                    ids.append(a)
                    out.append(b)
                continue
            words = line.split(" ")
            if k:
                w = words[0]
                a, b = bare.get(w) or self._known(bare, w, w)
                ids.append(a)
                out.append(b)
                del words[0]
            for w in words:
                a, b = prefixed.get(w) or self._known(prefixed, w, MARK + w)
                ids.append(a)
                out.append(b)
        ids.append(str(self.end))
        plain = "".join(out)
        return " ".join(ids), plain[1:] if plain.startswith(" ") else plain


def _utf8(raw: bytes) -> str:
    """UTF-8 with each byte that belongs to no character as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]", "�", raw.decode("utf-8", "surrogateescape"))


_models: dict[str, PieceBpe] = {}


def model(path: str) -> PieceBpe:
    """The tables of a model file, read once in each Python process."""
    if path not in _models:
        _models[path] = PieceBpe(path)
    return _models[path]


def _encode(path: str, digests: bool):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            ids, texts = [], []
            n = []
            for text in batch.column(1):
                a, b = bpe.encode(text.as_py() or "")
                n.append(a.count(" ") + 1)
                if digests:
                    a, b = hashlib.sha256(a.encode()).hexdigest(), hashlib.sha256(b.encode()).hexdigest()
                ids.append(a)
                texts.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return job


def encode_documents(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row of ``docs``: the ids joined by spaces and the text they decode to.

    With ``digests`` the tasks give the SHA-256 of both (lowercase hex of UTF-8), not the strings.
    """
    prepare(docs.sparkSession)
    return documents(docs, "doc_id", "text").mapInArrow(_encode(path, digests), "doc_id long, n_tokens long, ids string, decoded string")
