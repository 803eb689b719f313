"""SentencePiece merge-type (BPE) encoding by a prefix table, and decoding.

For merge-type models the encoding of every prefix of a text ends with one certain token. The table
stores that token for each prefix: an automaton gives all tokens that end at a position, and of these
exactly one is compatible with the last token of the prefix before it, that is, the two stand next to
each other in the encoding of their own concatenation. The ids are then read backwards from the end.
The time is linear in the text for tokens of bounded length, whatever the text; merging by a queue
happens only for pairs of tokens, when a pair is met first.

No token holds white space after another character, so nothing is merged across such a place and a
text is encoded in parts, of which each worker remembers a bounded number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame


#: How these models write a space (a fixed value of the format).
SPACE = "▁"


class PrefixEncoder:
    """Encodes and decodes like the model at ``path``: identity normaliser, a space before the text.

    ``remembered`` bounds the parts kept in each of two generations; it changes the time taken, never the ids.
    """

    def __init__(self, path: str, remembered: int = 250_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.end = model.eos_id()
        self.unknown = model.unk_id()
        self.byte_of = {i: int(self.pieces[i][3:-1], 16) for i in range(n) if model.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.control = {i for i in range(n) if model.is_control(i)}
        self.rank: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        for i in range(n):
            if i not in self.byte_of and i not in self.control and i != self.unknown:
                self.rank[self.pieces[i]] = -model.get_score(i)
                self.id_of[self.pieces[i]] = i
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a token of this model holds a space after another character")
        self.fits: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            if len(p) == 1 or self._merged(p) == [p]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.part = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.remembered = remembered
        self.known: dict[str, tuple[str, int, str]] = {}
        self.before: dict[str, tuple[str, int, str]] = {}
        self.decimal = {p: str(i) for p, i in self.id_of.items()}

    def _merged(self, text: str) -> list[str]:
        """The encoding of a short text by its merges, best first and leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min((self.rank[m], i) if (m := parts[i] + parts[i + 1]) in self.rank else (float("inf"), i) for i in range(len(parts) - 1))
            if best[0] == float("inf"):
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        """Whether the two stand next to each other in the encoding of their concatenation."""
        if len(self.fits) > 400_000:
            self.fits.clear()
        fits = self.fits[left, right] = self._merged(left + right) == [left, right]
        return fits

    def tokens(self, part: str) -> list[str]:
        """The tokens of one part; a character without a token stands for itself."""
        last: list[str | None] = [None] * (len(part) + 1)
        known = self.fits.get
        for stop, token in self.automaton.iter(part):
            stop += 1
            if last[stop] is None:
                start = stop - len(token)
                if start:
                    before = last[start] or part[start - 1]
                    fits = known((before, token))
                    if fits is None:
                        fits = self._compatible(before, token)
                    if not fits:
                        continue
                last[stop] = token
        out, at = [], len(part)
        while at:
            token = last[at] or part[at - 1]
            out.append(token)
            at -= len(token)
        out.reverse()
        return out

    def ids(self, tokens: list[str]) -> list[int]:
        out = []
        for t in tokens:
            i = self.id_of.get(t)
            if i is not None:
                out.append(i)
            elif self.id_of_byte:
                out += [self.id_of_byte[b] for b in t.encode()]
            else:
                out.append(self.unknown)
        return out

    def parts(self, text: str) -> list[str]:
        """Cut where no token can reach across; the space before the text included."""
        if not text:
            return []
        if text[0] == " " or "  " in text or SPACE in text:
            return self.part.findall(SPACE + text.replace(" ", SPACE))
        return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")

    def _learn(self, part: str) -> tuple[str, int, str]:
        got = self.before.get(part)
        if got is None:
            tokens = self.tokens(part) if "\n" not in part and SPACE not in part[1:] else [t for p in self.part.findall(part) for t in self.tokens(p)]
            try:
                got = (" ".join([self.decimal[t] for t in tokens]), len(tokens), "".join(tokens).replace(SPACE, " "))
            except KeyError:  # some character has no token
                ids = self.ids(tokens)
                got = (" ".join(map(str, ids)), len(ids), self._text(ids))
        if len(part) < 64:
            if len(self.known) >= self.remembered:
                self.before, self.known = self.known, {}
            self.known[part] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without an end id."""
        return [int(i) for p in self.parts(text or "") for i in self.tokens_as_text(p)[0].split(" ") if i]

    def tokens_as_text(self, part: str) -> tuple[str, int, str]:
        """Ids of a part as decimal text, how many they are, and what they decode to."""
        return self.known.get(part) or self._learn(part)

    def _text(self, ids: list[int]) -> str:
        """What ids stand for, spaces written out, nothing stripped."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_lenient(bytes(raw)))
                raw.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(self.pieces[i].replace(SPACE, " "))
        if raw:
            out.append(_lenient(bytes(raw)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes put together, control ids left out, the space before the text taken off."""
        text = self._text(ids)
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Ids with the end id: how many, hash of the ids, hash of what they decode to."""
        parts = self.parts(text or "")
        got = [self.known.get(p) or self._learn(p) for p in parts]
        ids = " ".join([g[0] for g in got] + [str(self.end)])
        decoded = "".join([g[2] for g in got])
        if got and parts[0][0] == SPACE:
            decoded = decoded[1:]
        return sum([g[1] for g in got]) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _lenient(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that is not part of a character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_encoders: dict[str, PrefixEncoder] = {}


def prefix_encoder(path: str) -> PrefixEncoder:
    """One encoder a Python worker."""
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` of ``docs(doc_id, text)`` without an end id; a null text has no ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = prefix_encoder(model).encode
        for b in batches:
            ids = pa.array([encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of ``encoded(doc_id, ids)``; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = prefix_encoder(model).decode
        for b in batches:
            text = pa.array([decode(i or []) for i in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """Ids with an end id and their decoded text, as digests: one row a document, one pass, no shuffle.

    Null and empty texts have the end id alone and decode to an empty text; repeated rows give
    repeated results.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = prefix_encoder(model).digest
        for b in batches:
            rows = [digest(t) for t in b.column(1).to_pylist()]
            n, ids, decoded = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
