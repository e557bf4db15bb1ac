"""Byte-pair encoding by a streaming transducer of bounded lookahead, and decoding by a state machine.

Encoding cuts a text into runs as the vocabulary file asks for (special strings, NFC,
lower case, contractions, runs of letters, single digits, other runs) and merges each
run. A run may be of any length, so it is merged in a window: the merge list is analysed
once for its sufficient lookahead, the number of symbols after which nothing that
follows can change a token any more, and tokens that end so far before the window's end
are emitted and leave it. Decoding turns ids to bytes and bytes to text, holding only
the bytes of a character that is not complete.

The lookahead: let two texts agree up to a place. As the rules are applied in their
order, the point up to which the tokens of both agree moves left only by a rule (u, v)
that applies in one text and not in the other, with u before the point and v behind it;
it moves by the length of u. The next rule to move it comes later in the list, and its v
begins with the token u. The longest such chain of rules bounds the way. It needs every
token to be made by one rule, from symbols or earlier products, which is checked.

Scale: rows are independent, so there is no shuffle. A task holds the vocabulary, a
bounded cache of short runs, and one slice of ``SLICE`` characters, besides the rows of
a batch. Only a run of combining marks is never cut, as their order may still change.

Cases: a null or empty text gives no tokens and decodes to an empty text; a special
string in a text is one token; null or unknown ids are left out when decoding; bytes
that are no UTF-8 become U+FFFD; repeated rows each give their own; other columns are
kept, but for ones named as a result.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import with_columns

SLICE = 1 << 16  # characters of a text worked on at a time
WINDOW = 2048  # symbols of a run merged at a time, besides the lookahead
CACHED = 1 << 19  # short texts kept with their tokens
SHORT = 64  # characters of a run or a word that may be kept
FEW = 32  # symbols of a run that is merged without a queue
ROOM = 1 << 24  # ids, in a number that holds a rule's rank and its product
LATEST = 1 << 60
IDS = 1 << 16  # ids decoded at a time

# Code points that the library's patterns and lower-casing know and those of Unicode 15.1 lack.
NEW_LETTERS = (
    "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4"
    "\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0"
    "\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0"
)
NEW_DIGITS = "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"
# Marks that its normal form takes for letters that join nothing.
LATE_MARKS = (
    "\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27\U00010eab-\U00010eac"
    "\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839-\U0001183a\U00011930\U0001193d-\U0001193e"
    "\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42\U00016ff0-\U00016ff1"
    "\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _ranges(kind: str, end: int = 0x110000) -> str:
    """A character class's inside: the code points below ``end`` whose category begins with ``kind``."""
    out, start = [], None
    for c in range(end + 1):
        inside = c < end and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(chr(start) if start == c - 1 else f"{chr(start)}-{chr(c - 1)}")
            start = None
    return "".join(out)


class Scanner:
    """Cuts text into runs, slice by slice."""

    def __init__(self) -> None:
        letters, digits = _ranges("L") + NEW_LETTERS, _ranges("N") + NEW_DIGITS
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        short = "|".join(CONTRACTIONS)
        self.runs = re.compile(f"{short}|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+")
        low_letters, low_digits = _ranges("L", 0x800), _ranges("N", 0x800)  # short classes, for most texts
        self.low_runs = re.compile(f"{short}|[{low_letters}]+|[{low_digits}]|[^{space}{low_letters}{low_digits}]+")
        self.plain = re.compile(rf"{short}|[a-z]+|[0-9]|[^\x09-\x0d a-z0-9]+")
        self.letter, self.other = re.compile(f"[{letters}]"), re.compile(f"[^{space}{letters}{digits}]")
        self.digit = re.compile(f"[{digits}]")
        self.letters, self.others = re.compile(f"[{letters}]*"), re.compile(f"[^{space}{letters}{digits}]*")
        self.late, self.high = re.compile(f"([{LATE_MARKS}])"), re.compile("[\u07fd-\U0010ffff]")
        # What follows a character and never joins it: a starter that is no second part of a composition.
        second = {unicodedata.decomposition(chr(c)).split()[1] for c in range(0x110000) if unicodedata.decomposition(chr(c)).count(" ") == 1 and "<" not in unicodedata.decomposition(chr(c))}
        self.joined = {chr(int(c, 16)) for c in second} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}

    def _free(self, text: str, at: int) -> bool:
        """Whether a text may be cut at a place inside a run, so that neither its normal form nor its runs change but for the cut one."""
        b, a, before = text[at], text[at - 1], text[at - 2] if at > 1 else " "
        if unicodedata.combining(b) or b in self.joined:
            return False
        if self.letter.match(a):
            return bool(self.letter.match(b)) and before != "'"
        return bool(self.other.match(a) and self.other.match(b)) and (a != "'" or bool(self.other.match(before)))

    def slices(self, text: str) -> Iterator[str]:
        """Parts of at most ``SLICE`` characters, cut at white space, else within a run where that is safe."""
        lo = 0
        while len(text) - lo > SLICE:
            hi = lo + SLICE
            cut = max(text.rfind(c, lo, hi) for c in " \n\t\r") + 1
            if cut <= lo:
                cut = hi
                while cut > lo and not self._free(text, cut):
                    cut -= 1
                if cut == lo:
                    cut = hi
                    while cut < len(text) and not (self._free(text, cut) or text[cut] in " \n\t\r"):
                        cut += 1
            yield text[lo:cut]
            lo = cut
        yield text[lo:]

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if self.high.search(text):
            text = "".join([unicodedata.normalize("NFC", part) for part in self.late.split(text)]).translate(NEW_LOWER)
        else:
            text = unicodedata.normalize("NFC", text)
        return text.replace("\u03a3", "\u03c3").lower()  # a sigma's form does not depend on its place

    def cut(self, text: str) -> list[str]:
        """The runs of a text in normal form."""
        if text.isascii():
            return self.plain.findall(text)
        return (self.runs if self.high.search(text) else self.low_runs).findall(text)


class Vocabulary:
    """A vocabulary file with word ends, its merge rules, and their sufficient lookahead."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.decoder = (spec.get("decoder") or {}).get("type")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        pattern = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.words = steps == ["NFC", "Replace", "Lowercase"] and pattern == [WORD_PATTERN, None] and model["type"] == "BPE"
        letters = byte_letters()
        self.bytes = {c: b for b, c in enumerate(letters)}
        ids = model["vocab"]
        self.inner = [ids.get(c) for c in letters]
        self.last = [ids.get(c + self.end) for c in letters]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rules = {(ids[u], ids[v]): rank * ROOM + ids[u + v] for rank, (u, v) in enumerate(merges, 1)}
        self.lookahead = lookahead(merges, {*letters, *(c + self.end for c in letters)}, self.end)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the rules in their order, each from left to right: the tokens of a run."""
        n, rule = len(symbols), self.rules.get
        if n <= FEW:
            found = [rule(pair, LATEST) for pair in zip(symbols, symbols[1:])]
            symbols = [*symbols]
            while found and (best := min(found)) != LATEST:
                i = found.index(best)
                symbols[i] = best & (ROOM - 1)
                del symbols[i + 1], found[i]
                if i < len(found):
                    found[i] = rule((symbols[i], symbols[i + 1]), LATEST)
                if i:
                    found[i - 1] = rule((symbols[i - 1], symbols[i]), LATEST)
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(found, i) for i, p in enumerate(zip(symbols, symbols[1:])) if (found := rule(p))]
        heapq.heapify(queue)
        symbols = [*symbols]
        while queue:
            found, i = heapq.heappop(queue)
            j = after[i]
            if j >= n or symbols[i] is None or rule((symbols[i], symbols[j])) != found:
                continue
            symbols[i], symbols[j] = found & (ROOM - 1), None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if next_ := rule((symbols[i], symbols[k])):
                    heapq.heappush(queue, (next_, i))
            h = before[i]
            if h >= 0 and (next_ := rule((symbols[h], symbols[i]))):
                heapq.heappush(queue, (next_, h))
        return [s for s in symbols if s is not None]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints in Latin-1, else the next ones from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def lookahead(merges: list[list[str]], symbols: set[str], end: str) -> int:
    """Symbols after which no text that follows changes a token: the longest chain of rules, each one's right part beginning with the one before's left."""

    def length(token: str) -> int:
        return len(token.removesuffix(end)) if end and token != end else len(token)

    left: dict[str, str] = {}
    reach: dict[str, int] = {}  # by left part: how far the rules so far move the point of agreement
    longest = 0
    for u, v in merges:
        made = u + v
        if made in left or made in symbols or not all(x in left or x in symbols for x in (u, v)):
            raise ValueError(f"the rule of {made!r} is not the only one, or comes before those of its parts")
        best, first = 0, v
        while first is not None:
            best, first = max(best, reach.get(first, 0)), left.get(first)
        left[made] = u
        reach[u] = max(reach.get(u, 0), length(u) + best)
        longest = max(longest, reach[u])
    return longest


class Transducer:
    """Tokens of one run that arrives in parts; holds a window of symbols."""

    def __init__(self, vocabulary: Vocabulary, window: int = WINDOW) -> None:
        self.vocabulary, self.window, self.open = vocabulary, window, []

    def feed(self, part: str) -> list[int]:
        """The tokens that are settled whatever follows."""
        voc, out = self.vocabulary, []
        self.open += [voc.inner[b] for b in part.encode("utf-8", "surrogatepass")]
        at = 0
        while len(self.open) - at > self.window + voc.lookahead:
            settled = 0
            for token in voc.merge(self.open[at : at + self.window + voc.lookahead]):
                size = len(voc.tokens[token])  # no word end in a run that goes on
                if settled + size > self.window:
                    break
                settled += size
                out.append(token)
            at += settled
        del self.open[:at]
        return out

    def finish(self) -> list[int]:
        """The run's last tokens."""
        *rest, last = self.open
        out = self.vocabulary.merge([*rest, self.vocabulary.last[self.vocabulary.inner.index(last)]])
        self.open = []
        return out


class Kept(dict):
    """What a function made of short texts; of the older half, only what is asked for again stays."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= SHORT:
            if len(self) >= CACHED // 2:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class Encoder:
    """Token ids of texts; runs, and parts between blanks, that came before are looked up."""

    def __init__(self, vocabulary: Vocabulary, window: int = WINDOW) -> None:
        if not vocabulary.words:
            raise ValueError("the vocabulary file asks for another normal form or other runs")
        self.vocabulary, self.window, self.scanner = vocabulary, window, Scanner()
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.run = Kept(self._run).__getitem__
        self.part = Kept(lambda text: b"".join(map(self.run, self.scanner.cut(text)))).__getitem__

    def _run(self, run: str) -> bytes:
        """Packed ids of a whole run."""
        if len(run) > self.window // 4:
            work = Transducer(self.vocabulary, self.window)
            return np.array(work.feed(run) + work.finish(), np.int32).tobytes()
        data, inner = run.encode(), self.vocabulary.inner  # all of it in one window
        return array("i", self.vocabulary.merge([*[inner[b] for b in data[:-1]], self.vocabulary.last[data[-1]]])).tobytes()

    def _stretch(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text without special strings; a run that a slice cuts goes on in the next."""
        scanner, open_, goes_on = self.scanner, None, None
        whole = len(text) <= SLICE
        for part in scanner.slices(text):
            part = scanner.normal(part)
            if open_ is not None:
                more = goes_on.match(part)[0]
                yield np.array(open_.feed(more), np.int32).tobytes()
                if len(more) == len(part):
                    continue
                yield np.array(open_.finish(), np.int32).tobytes()
                part, open_ = part[len(more) :], None
            *parts, last = part.replace("\n", " ").split(" ")
            yield b"".join(map(self.part, parts))
            if whole or not last:
                yield self.part(last)
                continue
            runs = scanner.cut(last)
            goes = bool(runs) and last.endswith(runs[-1]) and runs[-1] not in CONTRACTIONS and not scanner.digit.match(runs[-1])
            last = runs.pop() if goes else ""
            yield b"".join(map(self.run, runs))
            if last:
                open_, goes_on = Transducer(self.vocabulary, self.window), scanner.letters if scanner.letter.match(last) else scanner.others
                yield np.array(open_.feed(last), np.int32).tobytes()
        if open_ is not None:
            yield np.array(open_.finish(), np.int32).tobytes()

    def stream(self, text: str) -> Iterator[bytes]:
        """Packed ids (int32) of a text, in parts, as they are settled."""
        for part in self.special.split(text) if self.special else [text]:
            if part in self.vocabulary.special:
                yield np.int32(self.vocabulary.special[part]).tobytes()
            elif part:
                yield from self._stretch(part)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.stream(text)), np.int32)


class Text:
    """Bytes to text as they come: the state is the bytes of a character that is not complete."""

    def __init__(self) -> None:
        self.open = b""

    def feed(self, data: bytes) -> str:
        data = self.open + data
        keep = 0
        for back in range(1, min(4, len(data) + 1)):
            b = data[-back]
            if b < 0x80:
                break
            if b >= 0xC0:  # a first byte: of two, three or four
                keep = back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
                break
        self.open = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        last, self.open = self.open.decode("utf-8", "replace"), b""
        return last


class Decoder:
    """Ids to text as the vocabulary file says: bytes put together, or the tokens' own spelling with a space between."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        if vocabulary.decoder not in (None, "ByteLevel"):
            raise ValueError(f"no decoder of type {vocabulary.decoder}")
        self.spaced = vocabulary.decoder is None
        special, letters = set(vocabulary.special.values()), vocabulary.bytes
        self.table = {
            i: b" " + t.encode() if self.spaced else t.encode() if i in special or any(c not in letters for c in t) else bytes(letters[c] for c in t)
            for i, t in vocabulary.tokens.items()
        }

    def stream(self, ids: np.ndarray) -> Iterator[str]:
        """The text of ids, in parts."""
        state, first = Text(), self.spaced
        for lo in range(0, len(ids), IDS):
            data = b"".join([self.table.get(i, b"") for i in ids[lo : lo + IDS].tolist()])
            if first and data:
                data, first = data[1:], False
            yield state.feed(data)
        yield state.finish()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(vocabulary(path))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of a text column; ``path`` is the vocabulary file, on every executor."""

    def work(texts: pa.Array) -> list[pa.Array]:
        run = encoder(path)
        found = [b"".join(run.stream(t)) if t else b"" for t in texts.to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))]

    return with_columns(docs, text, f"`{ids}` array<int>", work)


def decode(coded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the text of a column of token ids; a column named ``text`` is replaced."""
    kept = [f for f in coded.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(text, T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(ids)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                work, made = decoder(path), []
                for row in part.column(place):
                    values = row.values
                    made.append("".join(work.stream(values.drop_null().to_numpy(zero_copy_only=False))) if values is not None else "")
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, pa.array(made, pa.string())], arrow, strict=True)], schema=arrow)

    return coded.mapInArrow(run, schema)
