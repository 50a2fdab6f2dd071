"""SentencePiece encoding and decoding with a merge-type prefix table.

The table stores, for every prefix of a chunk, the one token its encoding ends with.  That
token is unique: a sequence of tokens is the encoding of its text exactly if each pair of neighbours is
compatible, that is if the two pieces joined encode to just these two tokens.  So an
Aho-Corasick automaton over the pieces reports which pieces end at a place, and the one that is
compatible with the last token of the prefix before it is the entry.  The ids are then
recovered backwards from the last entry.  Compatibility is a pair's own property: it is tested once, by
merging the two pieces' text, and remembered.

Merges never cross a space mark (no piece has one after another character) nor a character that
no piece has, so texts are cut there into chunks, and each worker remembers the ids of recent
chunks in a table of bounded size.  Runs of space marks are merged last, from the left, into the
longest pieces; the last mark of a run belongs to the word after it if the word's encoding takes it in.

Tokenizers are given, never trained: the vocabulary file's path is a parameter.

Cases: a null text is read as empty; an empty text has the end id only and decodes to the empty
text; characters without a piece become byte pieces; a space mark (U+2581) in a text is a space, as
in the library; control pieces in a text are ordinary characters.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shopmetrics.llm.common import append_columns

#: Chunks a worker remembers, at most, and the longest chunk that is remembered.
CACHE, CACHED_LENGTH = 400_000, 64
#: Pairs whose compatibility a worker remembers, at most.
PAIRS = 2_000_000
MARK = "▁"

_RUNS = re.compile(f"{MARK}+|[^{MARK}]+")


def vocabulary(path: str) -> dict:
    """What the encoder needs of a model file: pieces with ids and scores, byte ids, the end id, and which
    pieces are text."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, byte = {}, {}
    for i in range(sp.vocab_size()):
        if sp.is_byte(i):
            byte[int(sp.id_to_piece(i)[1:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            plain[sp.id_to_piece(i)] = (i, sp.get_score(i))
    if len(byte) != 256 or any(MARK in p.lstrip(MARK) or p[0] == p[1:2] == MARK and p.strip(MARK) for p in plain):
        raise ValueError("the model needs byte pieces, and space marks only at the start of words or in runs")
    return {"plain": plain, "byte": byte, "end": sp.eos_id()}


class Encoder:
    """Encodes and decodes texts; holds the automaton, the pair table and the remembered chunks."""

    def __init__(self, vocab: dict):
        self.end, self.byte = vocab["end"], vocab["byte"]
        marks = {p: i for p, (i, _) in vocab["plain"].items() if not p.strip(MARK)}
        self.marks = sorted(((len(p), i) for p, i in marks.items()), reverse=True)
        self.plain = {p: x for p, x in vocab["plain"].items() if p.strip(MARK) or p == MARK}
        self.text = {i: p for p, (i, _) in vocab["plain"].items()}
        self.raw = {i: bytes([b]) for b, i in self.byte.items()}
        table = {i: p.encode() for i, p in self.text.items()} | self.raw
        self.bytes_of = [table.get(i, b"") for i in range(max(table) + 1)]
        self.letters = {p for p in self.plain if len(p) == 1}
        odd = {c for p in self.plain for c in p} - self.letters
        if odd:
            raise ValueError("a piece has a character that is no piece")
        self.automaton = ahocorasick.Automaton()
        for p, (i, _) in self.plain.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.known: dict[str, tuple[list[int], str]] = {}

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: the best pair first, from the left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = self.plain.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x[1] > best):
                    best, at = x[1], i
            if at < 0:
                return parts
            parts[at: at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether the texts of two tokens, joined, encode to just these two."""
        key = a << 32 | b
        out = self.pairs.get(key)
        if out is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            out = self.pairs[key] = self.merged(x + y) == [x, y]
        return out

    def stands(self, a: int) -> bool:
        """Whether a piece's text encodes to the piece."""
        out = self.alone.get(a)
        if out is None:
            out = self.alone[a] = self.merged(self.text[a]) == [self.text[a]]
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        """The ids of a chunk of known characters, by its prefix table."""
        n = len(chunk)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        pairs, fits, stands = self.pairs, self.fits, self.stands
        for e, (k, t) in self.automaton.iter(chunk):
            e += 1
            if last[e] >= 0:
                continue
            if k == e:
                good = stands(t)
            else:
                before = last[e - k]
                good = pairs.get(before << 32 | t)
                if good is None:
                    good = fits(before, t)
            if good:
                last[e], size[e] = t, k
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out

    def word_ids(self, word: str) -> list[int]:
        """The ids of a word that may have unknown characters; these are bytes by themselves."""
        letters = self.letters
        if letters.issuperset(word):
            return self.chunk_ids(word)
        out, i = [], 0
        for j, c in enumerate(word):
            if c not in letters:
                if j > i:
                    out += self.chunk_ids(word[i:j])
                out += [self.byte[b] for b in c.encode()]
                i = j + 1
        return out + (self.chunk_ids(word[i:]) if i < len(word) else [])

    def run_ids(self, k: int) -> list[int]:
        """The ids of ``k`` space marks: from the left, each as long as pieces go."""
        out = []
        while k:
            n, i = next(x for x in self.marks if x[0] <= k)
            out.append(i)
            k -= n
        return out

    def remember(self, word: str) -> tuple[list[int], str]:
        """A word's ids, and the same as text."""
        ids = self.word_ids(word)
        out = ids, " ".join(map(str, ids))
        if len(word) <= CACHED_LENGTH:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = out
        return out

    def chunks(self, text: str):
        """(ids, ids as text) chunk by chunk, the end id last."""
        known, remember = self.known, self.remember
        mark_id = self.plain[MARK][0]
        if text:
            for k, line in enumerate((" " + text.replace(MARK, " ")).split("\n")):
                if k:
                    yield known.get("\n") or remember("\n")
                words = line.split(" ")
                if words[0]:
                    yield known.get(words[0]) or remember(words[0])
                marks = 0
                for w in words[1:]:
                    marks += 1
                    if w:
                        w = MARK + w
                        got = known.get(w) or remember(w)
                        if marks > 1:
                            # The word keeps the last mark of a run unless that stays alone.
                            free = got[0][0] == mark_id
                            ids = self.run_ids(marks if free else marks - 1)
                            yield ids, " ".join(map(str, ids))
                            if free:
                                got = got[0][1:], " ".join(map(str, got[0][1:]))
                        yield got
                        marks = 0
                if marks:
                    ids = self.run_ids(marks)
                    yield ids, " ".join(map(str, ids))
        yield [self.end], str(self.end)

    def encode(self, text: str) -> list[int]:
        return [i for ids, _ in self.chunks(text) for i in ids]

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, marks as spaces, without the first one."""
        whole = b"".join(map(self.bytes_of.__getitem__, ids))
        mark = MARK.encode()
        if whole.startswith(mark) and ids[0] not in self.raw:
            whole = whole[len(mark):]
        return whole.replace(mark, b" ").decode("utf-8", "replace")


FIELDS = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
DIGEST = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
          T.StructField("decoded_sha256", T.StringType())]


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", digest: bool = False, prefix: str = "") -> DataFrame:
    """``docs`` with ``FIELDS`` (ids and decoded text) appended, or with their ``DIGEST``; no shuffle."""
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # bounded: one vocabulary file
    where = docs.columns.index(text_col)
    fields = [T.StructField(prefix + f.name, f.dataType) for f in (DIGEST if digest else FIELDS)]

    def of_task():
        own = vocab.value
        encoder = own.get("encoder")  # broadcasts stay with a worker, so do the remembered chunks
        if encoder is None:
            encoder = own["encoder"] = Encoder(own)

        def of_batch(batch):
            texts = (x.as_py() or "" for x in batch.column(where).cast(pa.large_string()))
            if not digest:
                both = [(ids, encoder.decode(ids)) for ids in map(encoder.encode, texts)]
                return [pa.array([ids for ids, _ in both], pa.list_(pa.int32())), pa.array([t for _, t in both], pa.string())]
            n, a, b = [], [], []
            for text in texts:
                found = list(encoder.chunks(text))
                ids = list(chain.from_iterable(part for part, _ in found))
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([s for part, s in found if part]).encode()).hexdigest())
                b.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

        return of_batch

    return append_columns(docs, fields, of_task)
