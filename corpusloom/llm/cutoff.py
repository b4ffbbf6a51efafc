"""Texts cut off before their end (P4; also the 'truncated' pairs of P2).

Method: the vocabulary of all texts is kept as a trie, here a table of its nodes, so that it may outgrow any single
machine. A text without a visible end is cut if its final token is unknown but a proper prefix of known words.
Where the final token is a known word, evidence decides: how often the words before the end closed a sentence
elsewhere in the corpus and how often they went on (the longest known context counts), whether the same whole text
recurs as an answer of its own, and whether the source's texts pile up at exactly this length.

Work per row is one pass in Arrow batches. The words of all texts are counted in the Python worker before the
shuffle; of the contexts only those are counted that fall on a slot of some unfinished text's context. That slot set
is a bit map of fixed size: it bounds the broadcast, and as it fills it lets more through without changing results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe import slices
from corpusloom.llm.common import HOT, SLOTS, hot_slots, slot_map, split_join
from corpusloom.session import materialize

#: Words of context that are looked up.
LENGTHS = (1, 2, 3, 4, 5, 6, 8, 11, 14)
#: A context must have been seen this often to decide, and a token to be a word.
SUPPORT = 2
#: Of whole texts that recur, those of so many tokens count as answers although some texts go on from them; longer ones only if none does.
SHORT = 8

# What may be put behind a cut, besides white space: dots, broken characters, and a remark, in brackets or not, that there is more.
_MORE = "(?:(?:text|message|answer|output|response|content) )?(?:cut(?: off| short)?|truncated|shortened|abridged|clipped|snip(?:ped)?|(?:read|see|show|load|view|click for) more|more|continue[sd]?(?: (?:below|overleaf|on next page))?|cont(?:'d|d)?\\.?|to be continued|omitted|end of (?:excerpt|preview)|\\.\\.\\.|…)"
_MARK = re.compile(rf"(?:\.\.\.|…|\ufffd|[\[(<{{] ?{_MORE} ?[\])>}}]|(?<![\w-])(?:read|see|show|view) more\W{{0,3}})$", re.I)
#: A visible end: a final stop, also inside quotes or brackets, or a closed reference in brackets.
_CLOSED = "(?:[.!?।。؟][\"'”’»)\\]]*|\\])$"
#: A stop that belongs to an abbreviation or to the first letter of a number.
_SHORTENED = "(?:^|[ \\t\\n(])(?:Rs|No|Nos|Art|Sec|Cap|Vol|p|pp|[A-Z])\\.$"
_ENDED, _ABBREVIATION = re.compile(_CLOSED), re.compile(_SHORTENED)

_BRACKETED = re.compile(r"\s*\[[^\[\]]*\]")
_STOP = re.compile(r"[.!?।。؟][\"'”’»)\]]*$")
_ABBR = re.compile(r"^\(?(?:Rs|No|Nos|Art|Sec|Cap|Vol|p|pp|[A-Z])\.$")
_OUTER = " .,;:!?\"'“”‘’«»()[]{}।"
_DIGIT = re.compile(r"\d")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0x5851F42D4C957F2D)
_LISTED = np.uint64(0xD1B54A32D192ED03)


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) | 1


class _Tokens:
    """Forms of raw tokens, kept by a worker: (full, bare, flags); flags: 1 ends a sentence, 2 is a list mark."""

    def __init__(self) -> None:
        self.of: dict[str, int] = {}
        self.full: list[int] = []
        self.bare: list[int] = []
        self.flag: list[int] = []
        self.word: list[str | None] = []

    def learn(self, new: list[str]) -> None:
        if len(self.of) > 500_000:
            self.__init__()
        for raw in new:
            core = raw.strip(_OUTER).lower()
            number = _DIGIT.search(core) is not None
            word = "0" if number else core
            after = "," if raw.rstrip("\"'”’)").endswith((",", ";", ":")) else ""
            flag = 1 if _STOP.search(raw) and not _ABBR.match(raw) else 2 if raw in ("*", "-", "•", "–") else 0
            self.of[raw] = len(self.full)
            self.full.append(_hash(word + after))
            self.bare.append(_hash(word))
            self.flag.append(flag)
            self.word.append(core if core and not number else None)


_KEPT: list[_Tokens] = []


def _forms() -> _Tokens:
    if not _KEPT:
        _KEPT.append(_Tokens())
    return _KEPT[0]


def _contexts(texts: list[str]) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all tokens of texts one after another: contexts by length, sentence ends, index among the forms, place in the sentence, end offsets, tokens per text.

    A context of k words is the bare token and the k - 1 full tokens before it; it does not reach across the start of
    its sentence, which counts as a word of its own. Items of a list are sentences, and their words are kept apart
    from those of running text.
    """
    forms = _forms()
    rows = [(_BRACKETED.sub("", t) if "[" in t else t).split() for t in texts]
    flat = [w for r in rows for w in r]
    if new := list({w: None for w in flat if w not in forms.of}):
        forms.learn(new)
        if any(w not in forms.of for w in flat):  # the table was started anew
            forms.learn(list({w: None for w in flat if w not in forms.of}))
    at = np.fromiter(map(forms.of.__getitem__, flat), np.int64, len(flat))
    full, bare, flag = np.array(forms.full, np.uint64)[at], np.array(forms.bare, np.uint64)[at], np.array(forms.flag, np.int8)[at]
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    ends = np.cumsum(n)
    first = np.zeros(len(flat) + 1, bool)
    first[0] = True
    first[ends] = True
    first = first[:-1] if len(flat) else first[:0]
    first[1:] |= flag[:-1] > 0
    where = np.arange(len(flat))
    place = where - np.maximum.accumulate(np.where(first, where, 0)) if len(flat) else where
    if len(flat):
        start = where - place
        item = np.where(start > 0, flag[start - 1] == 2, False)
        full, bare = np.where(item, full ^ _LISTED, full), np.where(item, bare ^ _LISTED, bare)
    closes = flag == 1
    closes[:-1] |= flag[1:] == 2
    out, total, power = {}, bare.copy(), 1
    for k in range(1, max(LENGTHS) + 1):
        if k in LENGTHS:
            out[k] = (total * _MIX) ^ (total >> np.uint64(29))
        power = power * int(_MIX) & (1 << 64) - 1
        shifted = np.zeros_like(full)
        if k < len(full):
            shifted[k:] = full[:-k]
        total = total + np.uint64(power) * np.where(place >= k, shifted, np.where(place == k - 1, _START, np.uint64(0)))
    return out, closes, at, place, ends, n


def _slots(c: np.ndarray) -> np.ndarray:
    return (c >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def rest_of(text: str) -> tuple[str, bool]:
    """A text without what may stand behind a cut, and whether it ends visibly."""
    size = -1
    while size != len(text):
        size = len(text)
        text = text.rstrip(" \t\n\r\xa0")
        if m := _MARK.search(text, max(0, len(text) - 60)):  # no mark is longer
            text = text[: m.start()]
    tail = text[-40:]
    return text, _ENDED.search(tail) is not None and _ABBREVIATION.search(tail) is None


def _whole(text: str) -> int:
    """A hash of a text as a whole, without case and outer marks; numbers count as equal."""
    return xxhash.xxh64_intdigest(" ".join("0" if _DIGIT.search(x) else x.strip(_OUTER).lower() for x in text.split()).encode("utf-8", "surrogatepass")) - (1 << 63)


_OPEN = "key string, source string, last string, same bigint, alike bigint, short boolean, broken boolean, length int, contexts array<struct<k:int,context:bigint>>"
_COUNTS = "kind int, word string, context bigint, n_end bigint, n_on bigint"


def _signed(c: np.ndarray) -> np.ndarray:
    return c.astype(np.uint64).view(np.int64)


def _unfinished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, source, text, length: the last token and the contexts of the texts that do not end visibly, one row per text."""
    for whole in batches:
        for b in slices(whole):
            keys, texts, size = b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("length").to_pylist()
            rests = [rest_of(t) for t in texts]
            open_ = [i for i, (t, ended) in enumerate(rests) if t and not ended]
            keys, size, sources = [keys[i] for i in open_], [size[i] for i in open_], b.column("source").take(pa.array(open_, pa.int64())).to_pylist()
            texts = [rests[i][0] for i in open_]
            c, _, at, place, ends, n = _contexts(texts)
            words = _forms().word
            rows = []
            for i, (key, t) in enumerate(zip(keys, texts)):
                line = t.rsplit("\n", 1)[-1]
                broken = line.count("[") > line.count("]") or line.count("(") > line.count(")") or t[-1:] in ",;([{“-" or (t[-1:] == '"' and t[-2:-1] in " (")
                p = ends[i] - 1
                # k of a context that holds all from the start of the sentence is negative
                contexts = [{"k": -k if k >= place[p] + 2 else k, "context": int(c[k][p].view(np.int64))} for shorter, k in zip((0, *LENGTHS), LENGTHS) if place[p] + 2 > shorter] if n[i] else []
                rows.append({"key": key, "source": sources[i], "last": words[at[p]] if n[i] else None, "same": xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63), "alike": _whole(t), "short": bool(n[i] <= SHORT), "broken": broken, "length": size[i], "contexts": contexts})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_OPEN_ARROW)


_OPEN_ARROW = pa.schema([("key", pa.string()), ("source", pa.string()), ("last", pa.string()), ("same", pa.int64()), ("alike", pa.int64()), ("short", pa.bool_()), ("broken", pa.bool_()), ("length", pa.int32()), ("contexts", pa.list_(pa.struct([("k", pa.int32()), ("context", pa.int64())])))])
_COUNTS_ARROW = pa.schema([("kind", pa.int32()), ("word", pa.string()), ("context", pa.int64()), ("n_end", pa.int64()), ("n_on", pa.int64())])


class _Sums:
    """Counts of a task by context, merged now and then."""

    def __init__(self) -> None:
        self.keys, self.ends, self.ons, self.size = [], [], [], 0

    def add(self, key: np.ndarray, end: np.ndarray) -> None:
        u, inverse = np.unique(key, return_inverse=True)
        e = np.bincount(inverse, end, len(u)).astype(np.int64)
        self.keys.append(u)
        self.ends.append(e)
        self.ons.append(np.bincount(inverse, minlength=len(u)) - e)
        self.size += len(u)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        u, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        out = u, np.bincount(inverse, np.concatenate(self.ends), len(u)).astype(np.int64), np.bincount(inverse, np.concatenate(self.ons), len(u)).astype(np.int64)
        self.__init__()
        return out


def _counter(wanted):
    """Counts of a partition: kind 0 words, 1 contexts (closed a sentence, went on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8), bitorder="little").astype(bool)
        words: Counter = Counter()
        sums = _Sums()

        def flush() -> Iterator[pa.RecordBatch]:
            u, e, o = sums.take()
            w = list(words)
            nothing, empty = [None] * len(w), np.zeros(len(w), np.int64)
            if w:
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(w), np.int32)), pa.array(w, pa.string()), pa.array(nothing, pa.int64()), pa.array([words[x] for x in w], pa.int64()), pa.array(empty)], schema=_COUNTS_ARROW)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int32)), pa.array([None] * len(u), pa.string()), pa.array(_signed(u)), pa.array(e), pa.array(o)], schema=_COUNTS_ARROW)
            words.clear()

        for whole in batches:
            for b in slices(whole):
                rests = [rest_of(t) for t in b.column("text").to_pylist()]
                texts, done = [t for t, _ in rests], np.array([ended for _, ended in rests], bool)
                c, event, at, place, ends, n = _contexts(texts)
                some = n > 0
                last = ends[some] - 1
                event[last] = done[some]
                counted = np.ones(len(at), bool)
                counted[last] = done[some]  # the end of an unfinished text is no evidence
                table = _forms().word
                for i, k in enumerate(np.bincount(at[counted], minlength=0).tolist()):
                    if k and (w := table[i]) is not None:
                        words[w] += k
                for shorter, k in zip((0, *LENGTHS), LENGTHS):
                    keep = counted & (place + 2 > shorter) & bits[_slots(c[k])]  # a shorter context that reaches the start is the same
                    sums.add(c[k][keep], event[keep])
                if sums.size > 2_000_000 or len(words) > 1_000_000:
                    yield from flush()
        yield from flush()

    return run


def cut_texts(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """Every text that does not end visibly, with ``cut``: whether it stops within a word or a sentence, and the ``rule`` that says so ('word':
    the trie, 'context', 'bracket', 'length'); texts: key string, source string, text string.

    ``key`` is unique per text. Null, empty and blank texts, and texts that end visibly, are no cases. Complete texts
    that merely lack a final stop, headings, lists and short answers are told from cut ones by the corpus' own
    evidence, so a text of which nothing similar exists counts as cut only if its last word is unfinished, a bracket
    is left open, or its source's texts pile up at this length. Contexts, last words and lengths that ``hot`` or more texts share are
    dealt to several tasks. An empty table gives an empty result.
    """
    t = texts.filter("text <> ''").select("key", "source", F.length("text").alias("length"), "text")
    # only what cannot have ended visibly is looked at here; the exact test follows in Python
    tail = F.right("text", F.lit(40))
    maybe = ~tail.rlike(_CLOSED) | tail.rlike(_SHORTENED) | tail.rlike("(?:\\.\\.\\.|\\])$")
    tails = materialize(t.filter(maybe).mapInArrow(_unfinished, _OPEN))
    asked = tails.select(F.explode("contexts.context").alias("h"))
    words = np.zeros(SLOTS // 64, np.uint64)
    # at most SLOTS / 64 rows, however large the corpus
    for r in slot_map(asked).collect():
        words[r.word] = r.bits & ((1 << 64) - 1)
    wanted = texts.sparkSession.sparkContext.broadcast(words.tobytes())
    counts = t.select("text").mapInArrow(_counter(wanted), _COUNTS)
    counts = materialize(counts.groupBy("kind", "word", "context").agg(F.sum("n_end").alias("n_end"), F.sum("n_on").alias("n_on")))
    return _decide(tails, counts, hot)


def _decide(tails: DataFrame, counts: DataFrame, hot: int) -> DataFrame:
    words = counts.filter("kind = 0 AND n_end >= %d" % SUPPORT).select("word", "n_end")
    lasts = tails.filter("last IS NOT NULL").select("last").distinct()
    # the nodes of the trie: every proper prefix of every known word
    nodes = words.filter(F.length("word") > 1).select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, 1, i))")).alias("node")).distinct()
    known = lasts.join(words.select(F.col("word").alias("last"), F.lit(True).alias("is_word")), "last", "left").join(nodes.select(F.col("node").alias("last"), F.lit(True).alias("is_prefix")), "last", "left")
    # distinct contexts first: each is looked up once, and its counts are dealt to the texts that end with it
    ends = tails.select("key", F.explode("contexts").alias("c")).select("key", "c.k", "c.context")
    seen = counts.filter("kind = 1").select("context", "n_end", "n_on").join(ends.select("context").distinct(), "context")
    n = F.col("n_end") + F.col("n_on")
    alone = {c: (tails, [c]) for c in ("last", "same", "alike")}
    slots = hot_slots({"context": (ends, ["context"]), "at": (tails, ["source", "length"]), **alone}, hot)
    best = split_join(ends, seen, ["context"], "key", "context", slots).groupBy("key").agg(F.max(F.when(n >= SUPPORT, F.struct(F.abs("k").alias("k"), "n_end", "n_on"))).alias("best"), F.max(F.when(F.col("k") < 0, F.col("n_on"))).alias("n_longer"))
    c = tails.drop("contexts").join(best, "key", "left")
    c = split_join(c, known, ["last"], "key", "last", slots)
    # how many unfinished texts are the same as a whole, and the same but for case, marks and numbers
    for name in ("same", "alike"):
        c = split_join(c, tails.groupBy(name).agg(F.count(F.lit(1)).alias(f"n_{name}")), [name], "key", name, slots)
    piled = tails.groupBy("source", "length").agg(F.count(F.lit(1)).alias("n_at"))
    # one row per source and length
    usual = piled.groupBy("source").agg((F.sum("n_at") / F.count(F.lit(1))).alias("n_usual"))
    piled = split_join(piled, usual, ["source"], "length", "", None)
    c = split_join(c, piled, ["source", "length"], "key", "at", slots)
    spike = (F.col("n_at") >= 5) & (F.col("n_at") > 4 * F.col("n_usual"))
    closes = F.col("best.n_end") / (F.col("best.n_end") + F.col("best.n_on"))
    longer = F.coalesce("n_longer", F.lit(0))
    own_answer = F.when(F.col("short"), ((F.col("n_same") >= 3) & (F.col("n_same") * 600 > longer)) | ((F.col("n_alike") >= 3) & (F.col("n_alike") * 100 > longer))).otherwise((F.col("n_same") >= 3) & (longer == 0) & (closes >= 0.5) & ~spike)
    unfinished_word = F.coalesce("is_prefix", F.lit(False)) & F.col("is_word").isNull()
    by_length = F.col("best").isNull() & spike
    by_context = F.when(F.col("best").isNull(), False).when(spike, closes < 0.9).otherwise(closes < 0.5)
    rule = F.when(F.col("broken"), "bracket").when(unfinished_word, "word").when(F.coalesce(own_answer, F.lit(False)), None).when(by_length, "length").when(by_context, "context")
    return c.withColumn("rule", rule).select("key", "source", "length", "last", "broken", "best", "n_longer", "is_word", "is_prefix", "n_same", "n_alike", spike.alias("spike"), "rule", F.col("rule").isNotNull().alias("cut"))
