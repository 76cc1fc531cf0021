"""BPE encoding and decoding equal to the tokenizers library's, and tree concatenation of long texts (operator 10).

Texts are cut where pre-tokens of the known kinds always end. The library encodes each distinct part once; texts are
put together from these by array operations, so what runs in Python is one step a distinct part.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Workspace, bounded_batches, groups, tidy

#: Texts longer than this many characters are encoded as trees of halves.
LONG = 16_384
#: Bytes of text handled at once (one text may have more), bytes of a part that is remembered at most, and parts that a
#: worker remembers.
STEP, SHORT, CACHE = 2_000_000, 64, 200_000
#: A unit that begins this far before a cut, or nearer, may read past it.
REACH = 4
#: Units longer than this are joined by merging a window of their tokens, not encoded anew.
UNIT = 64

#: Fixed value: the split pattern of the word tokenizers that are known here.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A part of one pre-token: letters on which Python and the library agree, and a space before them.
PLAIN = re.compile("[ \n\t\r]*([A-Za-zÀ-ÖØ-öø-įı-ſ]+)")
PLAIN_SPACED = re.compile("( ?[A-Za-zÀ-ÖØ-öø-įı-ſ]+)")


def _classes() -> np.ndarray:
    """Of each byte: 1 letter, 2 digit, 3 sign, 4 white space, 5 what may be white space, 0 apostrophe or above ASCII."""
    out = np.zeros(256, np.int8)
    for c in range(128):
        s = chr(c)
        out[c] = 1 if s.isalpha() else 2 if s.isdigit() else 4 if s in " \n\t\r" else 5 if s.isspace() else 3
    out[ord("'")] = 0
    return out


_CLASS = _classes()
#: Whether a pre-token always ends between a byte of one class and the next byte's.
_BREAK = np.array([[a != b and a in (1, 2, 3) and b in (1, 2, 3, 4) or b == 4 and a in (0, 1, 2, 3) for b in range(6)] for a in range(6)])
#: Lead bytes of the characters above ASCII among which white space is.
_LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def byte_alphabet() -> list[str]:
    """The printable character of each byte in byte-level vocabularies, by their published rule."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


_ALPHABET = dict(enumerate(byte_alphabet()))


def mapped(text: str) -> str:
    """The text's UTF-8 bytes in the byte alphabet."""
    if text.isascii() and text.isprintable():  # only the space changes
        return text.replace(" ", _ALPHABET[32])
    return text.encode("utf-8").decode("latin-1").translate(_ALPHABET)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of an array of strings; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about STEP bytes; a longer text is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + STEP, "right")))
        yield at, to
        at = to


class _Known:
    """Ids by part, as arrays. When full, the half that came up in the fewest steps goes."""

    def __init__(self, most: int):
        self.most = most
        self.keys, self.flat = pa.array([], pa.binary()), np.empty(0, np.uint32)
        self.size, self.seen = np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, parts: pa.Array) -> np.ndarray:
        """Places of the parts, -1 where unknown."""
        at = pc.fill_null(pc.index_in(parts, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.seen[at[at >= 0]] += 1
        return at

    def add(self, parts: pa.Array, flat: np.ndarray, size: np.ndarray) -> None:
        short = pc.binary_length(parts).to_numpy(zero_copy_only=False) <= SHORT
        self.keys = pa.concat_arrays([self.keys, parts.filter(pa.array(short))])
        self.flat = np.concatenate([self.flat, flat[np.repeat(short, size)]])
        self.size = np.concatenate([self.size, size[short]])
        self.seen = np.concatenate([self.seen, np.ones(int(short.sum()), np.int64)])
        if len(self.size) > self.most:
            keep = np.zeros(len(self.size), bool)
            keep[np.argsort(-self.seen, kind="stable")[: self.most // 2]] = True
            self.keys, self.flat = self.keys.filter(pa.array(keep)), self.flat[np.repeat(keep, self.size)]
            self.size, self.seen = self.size[keep], self.seen[keep] // 2


class Encoder:
    """Ids equal to the library's ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.path = path
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation(), self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        bare = lambda p: p.get("type") == "ByteLevel" and not p.get("add_prefix_space")
        spaced = bare(pre) and pre.get("use_regex") and not norm
        parts = pre.get("pretokenizers") or []
        self.worded = bool(
            len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
            and parts[0]["pattern"].get("Regex") == WORDS and bare(parts[1]) and not parts[1].get("use_regex")
            and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        )
        added = spec["added_tokens"]
        alone = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in added)
        model = spec["model"]
        merges = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
        #: Whether texts are cut into parts, and whether long texts can be joined from halves.
        self.parted = bool((spaced or self.worded) and alone)
        self.treed = self.parted and merges
        self.plain = PLAIN if self.worded else PLAIN_SPACED
        self.special = {t["content"]: t["id"] for t in added}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if added else None
        self.known = _Known(cache)

    def starts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First bytes of the parts: those of the texts, and places where a pre-token always ends."""
        first = np.zeros(len(data), bool)
        if self.parted and len(data):
            kind = _CLASS[data]
            first[1:] = _BREAK[kind[:-1], kind[1:]]
            lead = np.flatnonzero(_LEAD[data])
            for k in (2, 3):  # the character before may be white space above ASCII
                first[lead[lead + k < len(data)] + k] = False
            whole = data.tobytes()
            for mark in self.special:  # a special token's string stays whole
                mark, k = mark.encode(), -1
                while (k := whole.find(mark, k + 1)) >= 0:
                    first[k + 1 : k + len(mark)] = False
        first[at[:-1][at[1:] > at[:-1]]] = True
        return np.flatnonzero(first)

    def folded(self, data: np.ndarray) -> np.ndarray:
        """A-Z lower-cased where the tokenizer does so anyway, unless that would make a special token's string."""
        if not self.worded or not self.parted:
            return data
        low = _LOWER[data]
        whole = low.tobytes()
        return data if any(m.lower().encode() in whole for m in self.special) else low

    def made(self, parts: list[bytes]) -> list[list[int]]:
        """Ids of parts: a single plain pre-token goes to the library's model, all else through the whole library."""
        texts = [p.decode("utf-8", "replace") for p in parts]
        out: list = [None] * len(texts)
        rest = []
        for k, t in enumerate(texts):
            m = self.plain.fullmatch(t) if self.parted and len(t) <= SHORT else None
            if m:
                t = m[1].lower() if self.worded else m[1]
                out[k] = self.unit_ids(t)
            else:
                rest.append(k)
        for k, e in zip(rest, self.tok.encode_batch([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, ends of the parts' ids, first part of each text, bytes, starts of parts and the end)."""
        data, at = raw(texts)
        cut = self.starts(data, at)
        bounds = np.append(cut, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(self.folded(data)))])
        coded = words.dictionary_encode()
        known, slot = self.known, self.known.find(coded.dictionary)
        lost = np.flatnonzero(slot < 0)
        new = coded.dictionary.take(pa.array(lost))
        made = self.made(new.to_pylist())
        many = np.fromiter(map(len, made), np.int64, len(made))
        ids = np.fromiter(chain.from_iterable(made), np.uint32, int(many.sum()))
        slot[lost] = len(known.size) + np.arange(len(lost))
        size, flat = np.concatenate([known.size, many]), np.concatenate([known.flat, ids])
        if len(lost):
            known.add(new, ids, many)
        which = slot[coded.indices.to_numpy(zero_copy_only=False)]
        many = size[which]
        ends = np.concatenate([[0], np.cumsum(many)])
        place = np.repeat((np.cumsum(size) - size)[which] - ends[:-1], many)
        place += np.arange(len(place))
        return flat[place], ends, np.searchsorted(cut, at), data, bounds

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, n + 1 offsets of the texts in them)."""
        ids, ends, first, _, _ = self.parts(texts)
        return ids, ends[first]

    def batch(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encode(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    # -- units: pre-tokens, and what lies between them, without ids ---------------------------------
    def normal(self, text: str) -> str:
        return self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text

    def split(self, text: str) -> list[tuple[str, bool]]:
        """(unit, whether it is a pre-token) of a normalised text; the units cover it."""
        out, at = [], 0
        for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text):
            if a > at:
                out.append((text[at:a], False))
            out.append((text[a:b], True))
            at = b
        if at < len(text):
            out.append((text[at:], False))
        return out

    def unit_ids(self, unit: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(mapped(unit))]

    def units(self, text: str) -> list[tuple[str, list[int]]]:
        return [(u, self.unit_ids(u) if token else []) for u, token in self.split(text)]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker's encoder, kept with its cache from task to task."""
    return Encoder(path)


class Merger:
    """The merge rule on symbol lists, for joins inside one long pre-token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.vocab = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}

    def symbols(self, ids) -> list[str]:
        """Characters of the tokens; an end-of-word mark stays with the last one."""
        out: list[str] = []
        for i in ids:
            t = self.token[i]
            last = bool(self.end) and t.endswith(self.end)
            out.extend(t[: len(t) - len(self.end)] if last else t)
            if last:
                out[-1] += self.end
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        s = list(symbols)
        while len(s) > 1:
            best = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(s, s[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            pair = (s[best[1]], s[best[1] + 1])
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == pair:
                    out.append(s[i] + s[i + 1])
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            s = out
        return s

    def agrees(self, x: int, y: int) -> bool:
        return self.merge(self.symbols([x, y])) == [self.token[x], self.token[y]]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of one pre-token from those of its two parts. A token sequence is the encoding exactly when
        each adjacent pair encodes to itself, so the window around the cut grows until both its ends do."""
        k = 4
        while True:
            lo, hi = max(0, len(left) - k), min(len(right), k)
            window = self.symbols(left[lo:])
            if self.end and window:
                window[-1] = window[-1].removesuffix(self.end)
            got = [self.vocab[t] for t in self.merge(window + self.symbols(right[:hi]))]
            fine = (lo == 0 or self.agrees(left[lo - 1], got[0])) and (hi == len(right) or self.agrees(got[-1], right[hi]))
            if fine:
                return left[:lo] + got + right[hi:]
            k *= 2


class Tree:
    """Encodes leaves of a long text and joins neighbours. A node is (head, middle, tail): head and tail are the
    units next to its ends that no white space cuts off, middle the ids between; a solid node has no middle."""

    def __init__(self, enc: Encoder):
        self.enc = enc

    @functools.cached_property
    def merger(self) -> Merger:
        return Merger(self.enc.path)

    def leaves(self, texts: list[str]) -> list[tuple]:
        enc = self.enc
        ids, ends, first, data, at = enc.parts(pa.array(texts, pa.string()))
        units = lambda k: enc.units(enc.normal(bytes(data[at[k] : at[k + 1]]).decode()))
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a < 2:
                out.append((units(a) if b > a else [], None, []))
            else:
                out.append((units(a), [ids[ends[a + 1] : ends[b - 1]]], units(b - 1)))
        return out

    def units(self, a: list, b: list) -> list:
        """Units of two touching runs of them: re-split from the last units of a that are settled, through a
        growing number of units of b, until a boundary is one of b's."""
        if not a or not b:
            return a or b
        keep, size = len(a), 0
        while keep and size < REACH:
            keep -= 1
            size += len(a[keep][0])
        start, known = "".join(u for u, _ in a[keep:]), dict(a[keep:])
        k = 1
        while True:
            k = min(k, len(b))
            text = start + "".join(u for u, _ in b[:k])
            bounds, at = {}, len(start)
            for j, (u, _) in enumerate(b[:k]):
                bounds[at] = j
                at += len(u)
            new, at, done = [], 0, k == len(b)
            take = len(b)
            for u in self.enc.split(text):
                if at in bounds and at <= len(text) - REACH:
                    take, done = bounds[at], True
                    break
                new.append(u)
                at += len(u[0])
            if done:
                out = a[:keep]
                for u, token in new:
                    x, y = a[-1], b[0]
                    if not token:
                        out.append((u, []))
                    elif u == x[0] + y[0] and len(u) > UNIT:
                        out.append((u, self.merger.join(x[1], y[1])))
                    else:
                        out.append((u, known[u] if u in known else self.enc.unit_ids(u)))
                return out + b[take:]
            k *= 2

    def join(self, x: tuple, y: tuple) -> tuple:
        if x[1] is None:
            return (self.units(x[0], y[0]), y[1], y[2])
        if y[1] is None:
            return (x[0], x[1], self.units(x[2], y[0]))
        return (x[0], [*x[1], flat(self.units(x[2], y[0])), *y[1]], y[2])

    def whole(self, nodes: list[tuple]) -> np.ndarray:
        """Neighbours are joined pairwise, level by level."""
        while len(nodes) > 1:
            nodes = [self.join(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        head, middle, tail = nodes[0]
        return np.concatenate([flat(head), *(middle or []), flat(tail)])


def flat(units: list) -> np.ndarray:
    return np.array([i for _, ids in units for i in ids], np.uint32)


def apart(c: str) -> bool:
    """Whether Unicode composition never joins or moves the character over what stands before it."""
    if c < "\x80":
        return True
    if "ᄀ" <= c <= "ᇿ" or "ힰ" <= c <= "퟿":  # parts of Korean syllables
        return False
    kind = unicodedata.category(c)
    return kind[0] in "LNPSZ" and not unicodedata.combining(c) and (c <= "￿" or c >= "\U00020000" or kind[0] == "S")


def halves(text: str, most: int) -> list[str]:
    """Leaves of up to ``most`` characters, cut in the middle or at the next character that stands apart."""
    if len(text) <= most:
        return [text]
    mid = len(text) // 2
    while mid < len(text) and not apart(text[mid]):
        mid += 1
    if mid == len(text):
        return [text]
    return halves(text[:mid], most) + halves(text[mid:], most)


class Decoder:
    """Texts of ids, as the library's ``decode(ids, skip_special_tokens=False)``."""

    def __init__(self, tok: Tokenizer):
        self.tok = tok
        self.names = None
        if self.tok.decoder is None:
            vocab = self.tok.get_vocab(with_added_tokens=True)
            names: list[str | None] = [None] * (max(vocab.values(), default=-1) + 1)
            for t, i in vocab.items():
                names[i] = t
            self.names = pa.array(names, pa.string())

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """A tokenizer without a decoder joins its tokens by spaces; unknown ids have no token."""
        if self.names is not None and (not len(ids) or int(ids.max()) < len(self.names)):
            tokens = self.names.take(pa.array(ids))
            if not tokens.null_count:
                return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens), " ")
        lists = (ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True))
        return pa.array([self.tok.decode(x, skip_special_tokens=False) for x in lists], pa.string())


@functools.lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(encoder(path).tok)


def _columns(first: pa.Array, ids: np.ndarray, ends: np.ndarray, path: str | None) -> pa.RecordBatch:
    """id, ids and, where a path is given, the text decoded from the ids."""
    cols = [first, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))]
    if path:
        cols.append(decoder(path).texts(ids, ends))
    return pa.RecordBatch.from_arrays(cols, ["id", "ids", "decoded"][: len(cols)])


def _direct(path: str, back: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for a, b in steps(batch.column(1)):
                part = batch.slice(a, b - a)
                yield _columns(part.column(0), *enc.encode(part.column(1)), back)

    return run


def _leaves(path: str, long: int):
    """(id, row, leaf, special, text): halves of what stands between special tokens, and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for i, row, text in zip(*(batch.column(n) for n in ("id", "row", "t")), strict=True):
                text, found, at = text.as_py(), [], 0
                for m in enc.marks.finditer(text) if enc.marks else ():
                    found += [(None, x) for x in halves(text[at : m.start()], long) if x] + [(enc.special[m[0]], None)]
                    at = m.end()
                found += [(None, x) for x in halves(text[at:], long) if x]
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.as_py()] * n, pa.int64()), pa.array([row.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()),
                     pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.string())],
                    ["id", "row", "leaf", "special", "t"],
                )

    return run


_UNITS = "array<struct<u: string, ids: array<int>>>"
_NODE = f"id long, row long, leaf int, head {_UNITS}, mid binary, tail {_UNITS}"


def _nodes(path: str):
    unit = pa.list_(pa.struct([("u", pa.string()), ("ids", pa.list_(pa.int32()))]))

    def pack(units: list) -> list:
        return [{"u": u, "ids": i} for u, i in units]

    def node(special, got) -> tuple:
        if special is not None:
            return ([], [np.array([special], np.uint32)], [])
        return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(encoder(path))
        for batch in batches:
            for a, b in steps(batch.column("t")):
                part = batch.slice(a, b - a)
                leaves = tree.leaves([t or "" for t in part.column("t").to_pylist()])
                got = [node(s, x) for s, x in zip(part.column("special").to_pylist(), leaves, strict=True)]
                middle = [None if g[1] is None else np.concatenate(g[1]).astype("<u4").tobytes() for g in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("row"), part.column("leaf"), pa.array([pack(g[0]) for g in got], unit),
                     pa.array(middle, pa.binary()), pa.array([pack(g[2]) for g in got], unit)],
                    ["id", "row", "leaf", "head", "mid", "tail"],
                )

    return run


def _trees(path: str, back: str | None):
    def unpack(units: list) -> list:
        return [(x["u"], x["ids"]) for x in units]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(encoder(path))
        for _, g in groups(batches, ["row"]):
            nodes = [
                (unpack(h), None if m is None else [np.frombuffer(m, "<u4")], unpack(t))
                for h, m, t in zip(g["head"], g["mid"], g["tail"], strict=True)
            ]
            ids = tree.whole(nodes)
            yield _columns(pa.array(g["id"][:1], pa.int64()), ids, np.array([0, len(ids)]), back)

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, decoded: bool = False) -> DataFrame:
    """id, ids (array<int>) of each row's whole text: what the tokenizers library gives without special tokens added;
    with ``decoded`` also the text that ``decode`` gives of these ids, made in the same pass.

    Texts of up to ``long`` characters are encoded in place. A longer one is split at the strings of special tokens and
    halved between them, wherever the middle falls (before a character that Unicode composition leaves apart), down to
    leaves that are dealt to all tasks and encoded there. Neighbouring leaves are then joined level by level: a growing
    window around each cut is split anew until a unit boundary of both sides agrees, and, inside one long pre-token, a
    growing window of tokens is merged anew until the pairs at both its ends encode to themselves. Scripts make no
    difference. Tokenizers of another make (neither byte-level with the usual pattern nor words with ends) are encoded
    in place, so results never depend on ``long``.

    Null and empty texts have no ids (and decode to the empty text). Repeated and null ids are kept as rows of their
    own; other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    back, schema = (path, "id long, ids array<int>, decoded string") if decoded else (None, "id long, ids array<int>")
    tall = F.coalesce(F.length("t") > long, F.lit(False))
    if not Encoder(path).treed:
        out = src.mapInArrow(tidy(_direct(path, back)), schema)
    else:
        out = src.where(~tall).mapInArrow(tidy(_direct(path, back)), schema)
        # Written before its rows are dealt, so their numbers hold when a task runs again.
        rows = Workspace(docs.sparkSession, "long").save(src.where(tall).withColumn("row", F.monotonically_increasing_id()))
        leaves = rows.mapInArrow(tidy(_leaves(path, long)), "id long, row long, leaf int, special int, t string")
        nodes = leaves.repartition("row", "leaf").mapInArrow(tidy(_nodes(path)), _NODE)
        out = out.unionByName(nodes.repartition("row").sortWithinPartitions("row", "leaf").mapInArrow(tidy(_trees(path, back)), schema))
    return out.withColumnRenamed("id", id_col)


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            for i in range(0, batch.num_rows, 128):
                part, rows = batch.slice(i, 128), lists.slice(i, 128)
                size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
                ids = rows.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
                text = decoder(path).texts(ids, np.concatenate([[0], np.cumsum(size)]))
                text = pc.if_else(pc.is_valid(rows), text, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (with a column ids) and decoded, the library's text of the ids, special tokens included.

    A tokenizer without a decoder joins its tokens by spaces. Null ids give null, no ids the empty text.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded string"
    return encoded.mapInArrow(tidy(_texts(path)), schema)
