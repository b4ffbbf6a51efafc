"""Noise in text from scanned pages (P5).

Method: words, pairs of neighbours and titled lines of the whole corpus are counted; a symmetric-delete index over the
frequency lexicon gives candidates for tokens that are unknown or overshadowed by a look-alike; a weighted edit distance
that knows only the usual confusions accepts or rejects them, and the neighbouring words pick among them. Words split at
line ends are joined if the lexicon knows the joined word better than the hyphenated one. Titles are looked up by delete
keys too: a titled line that recurs in the corpus, or is a misread form of one that does, is a running header, as are
lines of a header's make-up; page numbers are numbers set apart as such.

Nothing of the corpus' size is broadcast or collected. Texts are dealt to groups of bounded size by a hash of their key. One
pass counts per group; candidates, contexts and titles are then decided by joins over distinct tokens, pairs and lines; each
group gets the decisions on what occurs in it, and a second pass repairs the group's texts with them. Every count is over
all texts and every threshold an absolute count, so a word is known as soon as it occurs ``LEAST`` times, whatever the size.
Two bit maps of fixed size are broadcast; they only keep rows from joins that would find nothing.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe import slices
from corpusloom.llm.common import marked, slot_map
from corpusloom.session import materialize

#: A word, pair or line seen this often is known.
LEAST = 3
#: A look-alike must be this much more frequent to overshadow a known word, and an unknown one.
OVER_KNOWN, OVER_UNKNOWN = 30, 5
#: Characters of text per group.
GROUP = 4_000_000
#: Parts into which the rows of a token are dealt in the join of its contexts.
SALT = 16

#: No line of print is longer; a longer line is one that lost its breaks and is searched for page furniture inside it.
PRINTED = 160
#: Letters of a word so long that another real word is hardly a confusion away.
LONG_WORD = 7
#: A title is a running header if it is a line of its own at least this often of all times that its words follow each other.
ALONE = 0.5

# What scanners confuse, (printed, read).
CONFUSIONS = (
    ("e", "c"), ("i", "í"), ("t", "†"), ("i", "!"), ("s", "5"), ("a", "@"), ("o", "0"), ("n", "ri"), ("c", "¢"),
    ("d", "cl"), ("l", "1"), ("u", "ii"), ("h", "b"), ("w", "vv"), ("m", "rn"), ("b", "6"), ("g", "9"), ("in", "m"),
    ("y", "v"), ("h", "li"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("li", "h"), ("cl", "d"), ("rn", "m"), ("b", "8"), ("i", "1"),
    ("", "~"), ("", "|"), ("", "^"),
)
_SIGNS = str.maketrans({"í": "i", "†": "t", "!": "i", "5": "s", "@": "a", "0": "o", "¢": "c", "1": "l", "6": "b", "9": "g", "8": "b", "ﬁ": "fi", "ﬂ": "fl", "~": "", "|": "", "^": ""})
_ODD = re.compile("[í†!5@0¢1698ﬁﬂ~|^]")
_MERGED = [(a, b) for a, b in CONFUSIONS if len(a) + len(b) == 3]
_OUTER = " .,;:()[]\"'“”‘’—–?…"
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_SPLIT = re.compile(r"^(.*?)([^\W\d_][\w†!@¢~|^]*)([-‐¬\xad])[ \t\r]*$")
_MARKS = "-‐¬\xad"
_NEXT = re.compile(r"^\s*([\w†!@¢~|^ﬁﬂ][\w†!@¢~|^ﬁﬂ'’]*(?:-[^\W\d_]+)*)")

_N = "[0-9lIOSB]{1,6}"
_ROMAN = "(?:(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))"
_PAGE_WORD = "(?:[Pp][a@]ge|PAGE|[Pp]gs?\\.|[Pp]p?\\.|Seite|Página|Pagina|Folio|[Ff]ol\\.|Blatt)"
#: A page number as printed apart from running text.
_DECORATED = rf"(?:{_PAGE_WORD} ?{_N}(?: (?:of|/|von|de|sur) {_N})?|\( {_N} \)|[-–—] {_N} [-–—]|~ {_N} ~|\[(?:p\. ?)?{_N}\]|{_N} A)"
_PAGE = re.compile(rf"(?:{_DECORATED}|{_ROMAN}|{_N} (?:/|of) {_N}|[*=_|•·<]+ ?{_N} ?[*=_|•·>]+)")
_BARE = re.compile(r"\d{1,5}")
_LED = re.compile(rf"^(?:(?P<n>{_DECORATED}|{_N}|{_ROMAN}) +)(?P<rest>\S.*)$")
_FOLLOWED = re.compile(rf"^(?P<rest>.*\S) +(?P<n>{_DECORATED}|{_N}|{_ROMAN})$")
_FOLLOWED_DECORATED = re.compile(rf"^(?P<rest>.*\S) +(?P<n>{_DECORATED})$")
_CHAPTER = re.compile(r"^(?:CAP\. ?\w+\] ?\S.*|\[C[a@]p\. ?\w+\]?)$")
_STARRED = re.compile(r"^\*{2,} .+ \*{2,}$")
_CONTINUED = re.compile(r"^([^\W\d_].{3,80}) [—–-] \S{8,11}$")
_STRUCTURE = re.compile(r"^\W*(?:\d+[.)]? )?(?:(?:first|second|third|fourth|fifth|sixth|\w+th) schedule|schedule|part|chapter|article|section|preamble|form|appendix|annex)\b", re.I)
_TITLE_END = re.compile(r"\b(?:ACT|LAW|ORDINANCE|CODE|CHARTER|CONSTITUTION|STATUTES?|GAZETTE|REGULATIONS|RULES|ORDER|DECREE|BILL)\b")
_DEC = rf"(?:{_DECORATED}|{_ROMAN}|{_N})"
_CAPS = r"[A-Z][A-Z]+(?:[ ,&-]+(?:[A-Z]{2,}|\([A-Z ]+\)))*"
#: Page furniture inside a line whose breaks were lost: with its page number before or behind it, or a page number alone.
_WITHIN = re.compile(
    rf"(?<=\S) ((?:{_DEC} +)?(?:CAP\. ?\w+\] {_CAPS}|\[C[a@]p\. ?\w+|\*{{3}} [^*]{{5,90}} \*{{3}}|(?:[A-Z]\S* (?:of |the |and )*|\([A-Z]\w+\) )+— \S{{8,11}}|(?:[A-Z(),&)-] +){{6,}}[A-Z)]\b|{_CAPS} (?:ACT|LAW|ORDINANCE)\.?)(?: {_DEC})?"
    rf"|P[a@]ge {_N} of {_N}|P[a@]ge {_N}|\( {_N} \)|- {_N} -|~ {_N} ~|\[p\. ?{_N}\]) (?=\S)"
)
_ITEM = re.compile(r"^\s*\d+[.)]? +\S")
_PARAGRAPH = re.compile(r"^\s*\(\d+[A-Z]?\)\s")


_MODAL = re.compile(r"\b(?:SHALL|MAY|MUST|IS|ARE|WAS|WERE|WILL|HAS|HAVE)\b")
_JOINING = {"of", "the", "and", "for", "to", "in", "on", "de", "la", "du", "des", "der", "von"}


def core_of(raw: str) -> str:
    return raw.strip(_OUTER).lower()


def line_key(line: str) -> str:
    return re.sub(r"\d+", "9", " ".join(line.split()))


def titled(line: str) -> bool:
    """Most words begin with a capital letter and no sentence ends here."""
    if line.rstrip().endswith((".", ";", ":", ",")):
        return False
    words = [w for w in line.split() if w[:1].isalpha()]
    return len(words) >= 2 and sum(w[0].isupper() for w in words) >= 0.7 * len(words)


def plain_title(line: str) -> bool:
    """A titled line that has no other mark of a header: such a line is one only if it recurs."""
    return len(line) <= PRINTED and titled(line) and not _STRUCTURE.match(line)


def title_spans(line: str) -> list[tuple[int, int]]:
    """(start, end) of what may be a title inside a line that lost its breaks: the beginnings and ends of runs of capitalised words."""
    tokens = list(re.finditer(r"\S+", line))
    capital = [t[0].lstrip("([")[:1].isupper() for t in tokens]
    out, i = set(), 0
    while i < len(tokens):
        if not capital[i]:
            i += 1
            continue
        j = i
        for k in range(i + 1, len(tokens)):
            if capital[k]:
                j = k
            elif tokens[k][0] not in _JOINING:
                break
        first, last = tokens[i].start(), tokens[j].end()
        for k in range(i + 1, j + 1):
            if capital[k] and tokens[k].end() - first <= PRINTED:
                out.add((first, tokens[k].end()))
            if capital[k - 1] and last - tokens[k - 1].start() <= PRINTED:
                out.add((tokens[k - 1].start(), last))
        i = j + 1
    return sorted(out)


_ALIKE = str.maketrans({"c": "e", "v": "y", "b": "h", "i": "l"})


def skeleton(text: str) -> str:
    """A text in which the usual confusions are one."""
    s = text.lower().translate(_SIGNS)
    for a, b in _MERGED:
        s = s.replace(max(a, b, key=len), min(a, b, key=len))
    return s.translate(_ALIKE)


def title_keys(title: str) -> set[str]:
    """The skeleton, also with one character or one word deleted."""
    s = skeleton(title)
    words = s.split()
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s))), *(" ".join(words[:i] + words[i + 1 :]) for i in range(len(words)) if len(words) > 2)}


def same_title(title: str, read: str) -> bool:
    return abs(len(title) - len(read)) < 4 and difflib.SequenceMatcher(None, title, read, autojunk=False).ratio() > 0.88


#: Up to so many characters a word is looked up by deletions; a longer one, which one deletion leaves equal in its first or last half of them, by these.
DELETED = 64


def delete_keys(word: str) -> set[str]:
    """The skeletons of a word, in which the usual confusions are one (with and without those of several letters), and what one deletion leaves of them."""
    out = set()
    for s in {skeleton(word), word.lower().translate(_SIGNS).translate(_ALIKE)}:
        out.add(s)
        if len(s) <= DELETED + 4:
            out.update(s[:i] + s[i + 1 :] for i in range(len(s)))
        if len(s) >= DELETED:
            out |= {"<" + s[: DELETED // 2], ">" + s[-DELETED // 2 :]}
    return out


def distance(printed: str, read: str, most: float = 1.0) -> float:
    """Cost of reading ``printed`` as ``read`` by confusions alone, 0.3 each; more than ``most`` if impossible."""
    far = most + 1
    rows: list[dict[int, float]] = [{} for _ in range(len(printed) + 1)]
    rows[0][0] = 0.0
    for i in range(len(printed) + 1):
        j_list = sorted(rows[i])
        while j_list:
            j = j_list.pop(0)
            cost = rows[i][j]
            if i < len(printed) and j < len(read) and printed[i] == read[j] and cost < rows[i + 1].get(j + 1, far):
                rows[i + 1][j + 1] = cost
            if cost + 0.3 <= most:
                for a, b in CONFUSIONS:
                    if printed.startswith(a, i) and read.startswith(b, j) and cost + 0.3 < rows[min(i + len(a), len(printed))].get(j + len(b), far):
                        rows[i + len(a)][j + len(b)] = cost + 0.3
                        if not a:
                            j_list.append(j + len(b))
    return rows[len(printed)].get(len(read), far)


#: All that a misread word can hold: letters, marks within words, and the signs that scanners read for letters.
_READ = re.compile(r"(?:[^\W\d_]|[-'’í†!5@0¢1698ﬁﬂ~|^])+")


def looked_up(core: str, own: int) -> tuple[set[str], int]:
    """The delete keys by which the printed form of a token is looked up, and how frequent it must be; no keys for a token that is no word."""
    letters, odd = sum(c.isalpha() for c in core), bool(_ODD.search(core))
    if not letters or len(core) < 2 or not _READ.fullmatch(core) or (any(c.isdigit() for c in core) and letters < sum(c.isdigit() for c in core)):
        return set(), 0
    if own > 200 and core.isalpha():
        odd = False
    plain = core.translate(_SIGNS)
    forms = {core, plain}
    # skeletons of overlapping confusions of several letters depend on their order, so each is also undone on its own
    for a, b in CONFUSIONS:
        at = plain.find(b) if len(a) + len(b) > 2 else -1
        while at >= 0:
            forms.add(plain[:at] + a + plain[at + len(b) :])
            at = plain.find(b, at + 1)
    most_rare = OVER_KNOWN if len(core) < LONG_WORD else OVER_UNKNOWN
    over = most_rare if own else 1 if odd else OVER_UNKNOWN
    return {k for f in forms for k in delete_keys(f)}, over * max(own, 1)


def admissible(word: str, n: int, core: str, own: int, least: int) -> bool:
    return word != core and abs(len(word) - len(core)) <= 4 and n >= least and (len(word) > 2 or n >= 20 * max(own, 1))


class Decisions:
    """What is known of the tokens, pairs and titles that occur in some texts.

    options: token -> (printed form, cost, count), cheapest and most frequent first; words: counts of words; left and right:
    pair -> count of the pair with each printed form (and the token itself) in place of its second or first word.
    """

    def __init__(self) -> None:
        self.options: dict[str, list[tuple[str, float, int]]] = {}
        self.words: dict[str, int] = {}
        self.left: dict[str, dict[str, int]] = {}
        self.right: dict[str, dict[str, int]] = {}
        self.titles: set[str] = set()
        self.cores: dict[str, tuple[str, bool]] = {}

    def candidates(self, core: str) -> list[tuple[str, float, int]]:
        """Words that may have been read as ``core``; empty if it is taken as it stands."""
        return self.options.get(core, [])

    def count(self, word: str) -> int:
        return self.words.get(word, 0)

    def around(self, before: str, core: str, word: str, after: str) -> int:
        return self.left.get(f"{before} {core}", {}).get(word, 0) + self.right.get(f"{core} {after}", {}).get(word, 0)

    def is_title(self, key: str) -> bool:
        return key in self.titles

    def known_form(self, raw: str) -> tuple[str, bool]:
        """The core of a token and whether it may be misread; kept for tokens seen before."""
        got = self.cores.get(raw)
        if got is None:
            core = core_of(raw)
            got = self.cores[raw] = core, bool(self.candidates(core))
        return got

    def repair(self, raw: str, before: str, after: str) -> str | None:
        """The token as printed if it was misread, else None."""
        core = core_of(raw)
        options = self.candidates(core)
        if not options:
            return None
        fits = [self.around(before, core, w, after) for w, _, _ in options]
        best = options[fits.index(max(fits))][0]  # the cheapest of equals; without any context the cheapest of all
        own = self.around(before, core, core, after)
        # a known word is misread only where its neighbours stand by the other word, and far less often by itself
        if self.count(core) and (max(fits) < 20 * own if own else not max(fits) and len(core) < LONG_WORD):
            return None
        at = raw.lower().find(core)
        if at < 0:
            return None
        first = raw[at : at + 1]
        if raw[at : at + len(core)].isupper() and len(core) > 1:
            best = best.upper()
        elif first.isupper() or (not first.isalpha() and (not before or before.endswith("."))):
            best = best[:1].upper() + best[1:]
        return raw[:at] + best + raw[at + len(core) :]

    def joins(self, left: str, right: str, mark: str) -> tuple[str, bool] | None:
        """What was printed where a line ends in left + mark and the next starts with right, and whether that is noise."""
        if left.isupper() and len(left) == 1 and right[0].isdigit():
            return f"{left}-{right}", False
        if not any(c.isalpha() for c in right):
            return None
        one, two = (left + right).lower(), f"{left}-{right}".lower()
        tail = re.match(r"[^\W\d_]+", right)
        if not right[0].isalpha() and not self.candidates(one) or len(left) == 1 and any(c.isdigit() for c in right):
            return f"{left}-{right}", False
        n_one, n_two = self.count(one), self.count(two)
        if n_one == 0 and n_two == 0:
            if self.candidates(one):
                n_one = 1
            elif self.count(left.lower()) and tail and self.count(right.lower()) and min(len(left), len(right)) > 3:
                n_two = 1
        if mark in "¬\xad":
            return (left + right, True) if n_two <= n_one or n_two == 0 else (f"{left}-{right}", False)
        return (f"{left}-{right}", False) if n_two > n_one else (left + right, True)

    def is_header(self, line: str) -> bool:
        """A running header by its make-up, or a title that recurs in the corpus as a line of its own."""
        if len(line) > PRINTED:
            return False
        if _CHAPTER.match(line) or _STARRED.match(line):
            return True
        if (m := _CONTINUED.match(line)) and titled(re.sub(" (?:of|the|and|for)(?= )", "", m[1])) and difflib.SequenceMatcher(None, line.rsplit(" ", 1)[1].lower(), "continued").ratio() > 0.7:
            return True
        parts = line.split()
        if len(parts) >= 6 and sum(len(p) == 1 for p in parts) >= 0.9 * len(parts):
            return True
        if _STRUCTURE.match(line):
            return False
        letters = [c for c in line if c.isalpha()]
        if len(parts) >= 2 and letters and sum(c.isupper() for c in letters) >= 0.85 * len(letters) and not _MODAL.search(line) and (_TITLE_END.search(line) or difflib.get_close_matches(parts[-1].strip("."), ("ACT", "LAW", "ORDINANCE"), 1, 0.6)):
            return True
        return titled(line) and self.is_title(line_key(line))


class Lexicon(Decisions):
    """The same decisions taken from counts of a whole corpus held in memory: for small corpora and for tests."""

    def __init__(self, words: dict[str, int], pairs: dict[str, int], lines: dict[str, int]) -> None:
        super().__init__()
        self.words, self.pairs = {w: n for w, n in words.items() if n >= LEAST}, pairs
        self.index: dict[str, list[str]] = {}
        for w in self.words:
            for key in delete_keys(w):
                self.index.setdefault(key, []).append(w)
        self.own_lines = {k for k, n in lines.items() if n >= LEAST and not _STRUCTURE.match(k) and n >= ALONE * min((pairs.get(p, 0) for p in line_pairs(k)), default=0)}
        self.by_key: dict[str, list[str]] = {}
        for t in self.own_lines:
            for key in title_keys(t):
                self.by_key.setdefault(key, []).append(t)
        self.fixed: dict[str, list[tuple[str, float, int]]] = {}

    def candidates(self, core: str) -> list[tuple[str, float, int]]:
        if core not in self.fixed:
            own = self.words.get(core, 0)
            keys, least = looked_up(core, own)
            near = {w for k in keys for w in self.index.get(k, ()) if admissible(w, self.words[w], core, own, least)}
            good = [(d, -self.words[w], w) for w in near if (d := distance(w, core)) <= 1]
            self.fixed[core] = [(w, d, -n) for d, n, w in sorted(good)]
        return self.fixed[core]

    def around(self, before: str, core: str, word: str, after: str) -> int:
        return sum(n for n in (self.pairs.get(f"{before} {word}", 0), self.pairs.get(f"{word} {after}", 0)) if n >= LEAST)

    def is_title(self, key: str) -> bool:
        return key in self.own_lines or any(same_title(t, key) for k in title_keys(key) for t in self.by_key.get(k, ()))


def line_pairs(key: str) -> list[str]:
    """The pairs of neighbouring plain words of a line."""
    cores = [c if _WORD.fullmatch(c := core_of(w)) else "" for w in key.split()]
    return [f"{a} {b}" for a, b in zip(cores, cores[1:]) if a and b]


def broken_up(line: str, known: Decisions) -> list[str]:
    """A line that lost its breaks, cut around page furniture inside it and behind words split by a hyphen."""
    cuts, end = [], 0
    for i, j in sorted(title_spans(line), key=lambda x: (x[0], -x[1])):
        if i >= end and 0 < i and j < len(line) and plain_title(line[i:j]) and known.is_title(line_key(line[i:j])):
            led = re.search(rf"(?:^| )({_DEC} +)$", line[end:i])
            cuts.append((i - len(led[1]) if led else i, j))
            end = j
    for i, j in reversed(cuts):
        line = f"{line[:i].rstrip()}\n{line[i:j]}\n{line[j:].lstrip()}"
    line = _WITHIN.sub(r"\n\1\n", line)
    return re.sub(r"([^\W\d_][-‐¬\xad]) +(?=[a-z])", r"\1\n", line).split("\n")


def furniture(line: str, table: bool, known: Decisions) -> set[str]:
    """The kinds of noise that a whole line is: 'page_number', 'header', both, or none if it belongs to the text."""
    s = line.strip(" \t\r\x0c")
    if not s or running(s):
        return set()
    if _PAGE.fullmatch(s):
        return {"page_number"}
    if _BARE.fullmatch(s):
        return set() if table else {"page_number"}
    for pattern in (_LED, _FOLLOWED_DECORATED, _FOLLOWED):
        if (m := pattern.match(s)) and known.is_header(m["rest"]):
            return {"page_number", "header"}
    return {"header"} if known.is_header(s) else set()


#: What a header in small letters has: a chapter mark, stars, or a dash before its last word.
_SMALL = re.compile(r"CAP|\[C|\*\*| [—–-] \S{8,11}(?: |$)")


def running(line: str) -> bool:
    """A line that no pattern of page furniture can match: four words or more, and more than half, begin with a small letter, less
    than half of all letters are capitals, less than half of the words are single letters, and it has no mark of a header in small letters.

    A page number has at most three words. Of a header with a page number of at most four words ('Page 3 of 9') beside it the
    rest must be titled (7 words in 10 begin with a capital), in capitals (17 letters in 20), or set in single letters (9 words in 10).
    """
    words = line.split()
    initial = "".join([w[0] for w in words])
    small = sum(map(str.islower, initial))
    if small < 4 or 2 * small <= len(initial) or _SMALL.search(line):
        return False
    return 2 * list(map(len, words)).count(1) < len(words) and (line[1:].islower() or 2 * sum(map(str.isupper, line)) < sum(map(str.isalpha, line)))


_HINT = re.compile(r"[—*\[~]|CAP|P[a@]ge|\d A$| \)$| -$|[A-Z]\S*\)?\.?$")
_STARTS = re.compile(r"(?<=\s)(?=[A-Z0-9*\[(~-]|[ivxlcdm]+ )")
_TRAILS = re.compile(rf"(?:P[a@]ge {_N}(?: of {_N})?|\( {_N} \)|- {_N} -|~ {_N} ~|\[p\. ?{_N}\]|{_N} A|{_ROMAN})")


def trailing_furniture(line: str, known: Decisions) -> tuple[int, set[str]]:
    """Where page furniture begins that was run into the end of a line of text, and its kinds; the line's length if there is none."""
    if len(line) > 20 and _HINT.search(line):
        for m in _STARTS.finditer(line, max(4, len(line) - PRINTED)):
            rest = line[m.start() :].strip()
            if not _BARE.fullmatch(rest) and (len(rest) > 12 or not re.fullmatch(_ROMAN, rest)) and (not _PAGE.fullmatch(rest) or _TRAILS.fullmatch(rest)) and (kinds := furniture(rest, True, known)):
                return m.start(), kinds
    return len(line), set()


def repair_text(text: str, known: Decisions, heading: int = 0) -> tuple[str, set[str]]:
    """The text as continuous paragraphs and the kinds of noise found; the first ``heading`` lines are never page furniture."""
    found: set[str] = set()
    lines = [y for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") for y in (broken_up(x, known) if len(x) > PRINTED else (x,))]
    solid = [x.strip(" \t\x0c") for x in lines]
    kept: list[str] = []  # '' stands for a blank line, None-like marks are not needed
    gap = False  # page furniture was removed since the last line
    for i, line in enumerate(solid):
        if not line:
            if kept and kept[-1] and not gap:
                kept.append("")
            continue
        table = False
        if _BARE.fullmatch(line):
            before = next((solid[j] for j in range(i - 1, max(-1, i - 4), -1) if solid[j]), "")
            after = next((solid[j] for j in range(i + 1, min(len(solid), i + 4)) if solid[j]), "")
            table = bool(_ITEM.match(before)) and (not after or bool(_ITEM.match(after)))
        kinds = furniture(line, table, known) if i >= heading or "\x0c" in lines[i] else set()
        if kinds:
            found |= kinds
            if kept and not kept[-1] and len(kept) > 1 and not kept[-2].endswith((".", ";", ":", "—")):
                kept.pop()
            gap = True
            continue
        end, kinds = trailing_furniture(line, known)
        if kinds:
            found |= kinds
            line = line[:end].rstrip()
        kept.append(line)
        gap = False
    out: list[str] = []
    i = 0
    while i < len(kept):
        line = kept[i]
        j = i + 1
        while line and line[-1] in _MARKS and j < len(kept) and kept[j] and (m := _SPLIT.match(line)) and (n := _NEXT.match(kept[j])) and (got := known.joins(m[2], n[1], m[3])):
            if got[1]:
                found.add("hyphenation")
            line = m[1] + got[0] + kept[j][n.end() :]
            j += 1
        out.append(line)
        i = j
    words = [w.split() for w in out]
    cores = known.cores
    forms = [[cores.get(w) or known.known_form(w) for w in ws] for ws in words]
    for k, ws in enumerate(words):
        if not any(may for _, may in forms[k]):
            continue
        for p, (raw, (_, may)) in enumerate(zip(list(ws), forms[k])):
            if may:
                j = p - 1 if p else len(words[k - 1]) - 1
                row = k if p else k - 1
                previous = words[row][j] if row >= 0 and j >= 0 else "."
                nxt = forms[k][p + 1][0] if p + 1 < len(ws) else forms[k + 1][0][0] if k + 1 < len(words) and words[k + 1] else ""
                fixed = known.repair(raw, "." if previous.endswith(".") else forms[row][j][0], nxt)
                if fixed is not None and fixed != raw:
                    found.add("characters")
                    ws[p] = fixed
    paragraphs: list[str] = []
    fresh = True
    for k, ws in enumerate(words):
        line = " ".join(ws)
        if not line:
            fresh = True
            continue
        item = bool(_ITEM.match(line)) or k < heading
        if fresh or not paragraphs or _PARAGRAPH.match(line) or item:
            paragraphs.append(line)
        else:
            paragraphs[-1] += " " + line
        fresh = k < heading
    return "\n\n".join(paragraphs), found


class _Asking(Decisions):
    """Knows no title and notes which are looked up."""

    def is_title(self, key: str) -> bool:
        self.titles.add(key)
        return False


_COUNTS = "pid int, kind int, what string, n bigint"
#: Kinds of what is counted: words, pairs and plain titles; and of what is asked besides, with n = 0: tokens that are no plain words,
#: pairs that a repair may bring together, parts of words split at line ends, and title spans inside long lines.
_WORDS, _PAIRS, _LINES, _TOKENS, _MEETING, _PARTS, _SPANS = range(7)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts and questions of each group of a partition; a record that repeats within a group counts once."""
    counts: dict[int, list[Counter]] = {}
    forms: dict[str, tuple[str, bool]] = {}
    seen: set[tuple] = set()
    asking = _Asking()
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for pid, kinds in counts.items():
            for kind, c in enumerate(kinds):
                if kind in (_PAIRS, _MEETING):
                    c = {f"{a} {b}": n for (a, b), n in c.items() if a and b}
                c.pop("", None)
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array([pid] * len(c), pa.int32()), pa.array([kind] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["pid", "kind", "what", "n"])
        counts.clear()

    for whole in batches:
        for b in slices(whole):
            for pid, key, text in zip(b.column("pid").to_pylist(), b.column("key").to_pylist(), b.column("text").to_pylist()):
                if (pid, key) in seen:
                    continue
                seen.add((pid, key))
                c = counts.setdefault(pid, [Counter() for _ in range(7)])
                whole_lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                lines = [x.split() for x in whole_lines]
                long = [x for x in whole_lines if len(x) > PRINTED]
                known: list[list[str]] = []
                run = [len(x) <= PRINTED and running(x) for x in whole_lines]
                for raw, runs in zip(lines, run):
                    for w in raw:
                        if w not in forms:
                            core = core_of(w)
                            forms[w] = core, _WORD.fullmatch(core) is not None
                    fs = [forms[w] for w in raw]
                    plain = [f if is_word else "" for f, is_word in fs]
                    cores = [f for f, _ in fs]
                    c[_WORDS].update(plain)
                    c[_PAIRS].update(zip(plain, plain[1:]))
                    if plain != cores:
                        odd = {f: 0 for f, is_word in fs if not is_word and _READ.fullmatch(f)}
                        c[_TOKENS].update(odd)
                        c[_MEETING].update({p: 0 for p in zip(cores, cores[1:]) if p[0] in odd or p[1] in odd})
                    known.append(cores)
                    if not runs and len(raw) > 1 and plain_title(line := " ".join(raw)):
                        c[_LINES][line_key(line)] += 1
                asking.titles.clear()
                ends = [x[-1] if x else "" for x in lines]
                for i, (line, runs) in enumerate(zip(whole_lines, run)):
                    if len(line) <= PRINTED and (runs or not furniture(line, False, asking)):
                        line = line.strip(" \t\x0c")
                        end, kinds = trailing_furniture(line, asking)
                        if kinds and (rest := line[:end].split()):
                            ends[i] = rest[-1]
                full = [i for i, x in enumerate(lines) if x]
                for at, i in enumerate(full):
                    # what follows on the next lines, also behind page furniture between them
                    last = ends[i]
                    for j in full[at + 1 : at + 5]:
                        c[_MEETING][known[i][-1], known[j][0]] += 0
                        if last[-1] in _MARKS and (m := _SPLIT.match(last)) and (n := _NEXT.match(lines[j][0])):
                            left, right = m[2].lower(), n[1].lower()
                            one, two = core_of(left + lines[j][0]), core_of(f"{left}-{lines[j][0]}")
                            for w in (left, right, left + right, f"{left}-{right}", one, two):
                                c[_PARTS][w] += 0
                            for w in (one, two):
                                if len(known[i]) > 1:
                                    c[_MEETING][known[i][-2], w] += 0
                                if len(known[j]) > 1:
                                    c[_MEETING][w, known[j][1]] += 0
                        if run[j]:
                            break
                for line in long:
                    for piece in broken_up(line, asking):
                        if not furniture(piece, False, asking):
                            trailing_furniture(piece.strip(" \t\x0c"), asking)
                    for raw in re.findall(r"([^\W\d_][\w†!@¢~|^]*)([-‐¬\xad]) +([a-z]\S*)", line):
                        for w in (core_of(raw[0]), core_of(raw[2]), core_of(raw[0] + raw[2]), core_of(f"{raw[0]}-{raw[2]}")):
                            c[_PARTS][w] += 0
                c[_SPANS].update(dict.fromkeys(asking.titles, 0))
                size += len(text)
            if len(forms) > 500_000:
                forms.clear()
            if size > 8 * GROUP:
                yield from flush()
                size = 0
    yield from flush()


def _mapped(df: DataFrame, schema: str, each) -> DataFrame:
    """Rows made of each row in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for x in b.to_pylist() for r in each(**x)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    # little data, much work: not left to a few large partitions
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, schema)


def _candidates(counts: DataFrame, words: DataFrame) -> DataFrame:
    """(token, own, options array<struct<w, d, n>>): the printed forms of every token that may be misread."""
    tokens = counts.filter(F.col("kind").isin(_WORDS, _TOKENS, _PARTS)).select(F.col("what").alias("token")).distinct().join(words.select(F.col("word").alias("token"), F.col("n").alias("own")), "token", "left").fillna(0, ["own"])

    def asked(token: str, own: int) -> Iterable[dict]:
        keys, least = looked_up(token, own)
        return ({"key": k, "token": token, "own": own, "least": least} for k in keys)

    printed = _mapped(words, "key string, w string, n bigint", lambda word, n: ({"key": k, "w": word, "n": n} for k in delete_keys(word)))
    pairs = _mapped(tokens, "key string, token string, own bigint, least bigint", asked).join(printed, "key")
    near = pairs.filter((F.col("w") != F.col("token")) & (F.col("n") >= F.col("least")) & (F.abs(F.length("w") - F.length("token")) <= 4) & ((F.length("w") > 2) | (F.col("n") >= 20 * F.greatest("own", F.lit(1)))))
    near = near.select("token", "own", "w", "n").distinct()

    def costed(token: str, own: int, w: str, n: int) -> Iterable[dict]:
        d = distance(w, token)
        return [{"token": token, "own": own, "w": w, "d": d, "n": n}] if d <= 1 else []

    good = _mapped(near, "token string, own bigint, w string, d double, n bigint", costed)
    # the printed forms of one token: bounded by the confusions within it
    return good.groupBy("token", "own").agg(F.array_sort(F.collect_list(F.struct("d", (-F.col("n")).alias("m"), "w"))).alias("options"))


def _contexts(counts: DataFrame, candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tag, what, options): of every pair with a token that may be misread, its counts with the printed forms in the token's place."""
    asked = counts.filter(F.col("kind").isin(_PAIRS, _MEETING)).select("what").distinct().select("what", F.substring_index("what", " ", 1).alias("a"), F.substring_index("what", " ", -1).alias("b"))
    slots = slot_map(candidates.select(F.xxhash64("token").alias("h")))
    salt = F.pmod(F.xxhash64("what"), F.lit(SALT)).alias("salt")
    forms = candidates.select("token", F.explode(F.concat(F.transform("options", lambda o: o["w"]), F.array("token"))).alias("w")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    seen = pairs.select(F.col("what").alias("pair"), "n")
    out = None
    for tag, token in (("L", "b"), ("R", "a")):
        q = marked(asked, F.xxhash64(token), slots).select("what", "a", "b", F.col(token).alias("token"), salt).join(forms, ["token", "salt"])
        pair = F.concat_ws(" ", "a", "w") if tag == "L" else F.concat_ws(" ", "w", "b")
        got = q.select("what", "w", pair.alias("pair")).join(seen, "pair").groupBy("what").agg(F.collect_list(F.struct(F.lit(0.0).alias("d"), (-F.col("n")).alias("m"), "w")).alias("options"))
        got = got.select(F.lit(tag).alias("tag"), "what", F.lit(0).cast("bigint").alias("own"), "options")
        out = got if out is None else out.unionByName(got)
    return out


def _titles(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(what): the plain titles and title spans that are running headers or misread forms of one."""
    lines = totals.filter(F.col("kind") == _LINES).select(F.col("what").alias("line"), "n")
    own = lines.filter(F.col("n") >= LEAST)
    paired = _mapped(own, "line string, n bigint, pair string", lambda line, n: ({"line": line, "n": n, "pair": p} for p in line_pairs(line) or [""]))
    seen = totals.filter(F.col("kind") == _PAIRS).select(F.col("what").alias("pair"), F.col("n").alias("m"))
    alone = paired.join(seen, "pair", "left").groupBy("line").agg(F.first("n").alias("n"), F.min(F.coalesce("m", F.lit(0))).alias("m")).filter(F.col("n") >= ALONE * F.col("m")).select("line")
    alone = materialize(alone)
    asked = counts.filter(F.col("kind").isin(_LINES, _SPANS)).select(F.col("what").alias("line")).distinct()
    keyed = lambda df, name: _mapped(df, f"key string, {name} string", lambda line: ({"key": k, name: line} for k in title_keys(line)))
    near = keyed(asked, "line").join(keyed(alone, "title"), "key").select("line", "title").distinct().filter((F.abs(F.length("line") - F.length("title")) < 4))
    return _mapped(near, "what string", lambda line, title: [{"what": line}] if line == title or same_title(title, line) else []).distinct()


def _decisions(groups: DataFrame) -> DataFrame:
    """(pid, tag, what, own, options): per group what is decided of its tokens ('C'), word parts ('N'), pairs ('L', 'R') and titles ('T')."""
    counts = materialize(groups.select("pid", "key", "text").mapInArrow(_count, _COUNTS).groupBy("pid", "kind", "what").agg(F.sum("n").alias("n")))
    totals = materialize(counts.filter(F.col("kind").isin(_WORDS, _PAIRS, _LINES)).groupBy("kind", "what").agg(F.sum("n").alias("n")))
    words = totals.filter((F.col("kind") == _WORDS) & (F.col("n") >= LEAST)).select(F.col("what").alias("word"), "n")
    candidates = materialize(_candidates(counts, words))
    none = F.array().cast("array<struct<d:double,m:bigint,w:string>>").alias("options")
    parts = counts.filter(F.col("kind") == _PARTS).select(F.col("what").alias("word")).distinct().join(words, "word").select(F.lit("N").alias("tag"), F.col("word").alias("what"), F.col("n").alias("own"), none)
    known = candidates.select(F.lit("C").alias("tag"), F.col("token").alias("what"), "own", "options")
    pairs = totals.filter((F.col("kind") == _PAIRS) & (F.col("n") >= LEAST))
    titles = _titles(counts, totals).select(F.lit("T").alias("tag"), "what", F.lit(0).cast("bigint").alias("own"), none)
    answers = materialize(known.unionByName(parts).unionByName(_contexts(counts, candidates, pairs)).unionByName(titles))
    tags = F.when(F.col("kind").isin(_WORDS, _TOKENS), F.array(F.lit("C"))).when(F.col("kind") == _PARTS, F.array(F.lit("C"), F.lit("N"))).when(F.col("kind").isin(_PAIRS, _MEETING), F.array(F.lit("L"), F.lit("R"))).otherwise(F.array(F.lit("T")))
    asked = counts.select("pid", "what", F.explode(tags).alias("tag"))
    asked = marked(asked, F.xxhash64("tag", "what"), slot_map(answers.select(F.xxhash64("tag", "what").alias("h"))))
    return asked.distinct().join(answers, ["tag", "what"])


def decisions_of(facts: pd.DataFrame) -> Decisions:
    out = Decisions()
    for tag, what, own, options in zip(facts.tag, facts.what, facts.own, facts.options):
        if tag == "C":
            out.options[what] = [(o["w"], o["d"], -o["m"]) for o in options]
            if own:
                out.words[what] = own
        elif tag == "N":
            out.words[what] = own
        elif tag == "T":
            out.titles.add(what)
        else:
            (out.left if tag == "L" else out.right)[what] = {o["w"]: -o["m"] for o in options}
    return out


def repair_scans(texts: DataFrame, group: int = GROUP) -> DataFrame:
    """(record_type, record_id, repaired, noise array<string>) of every text; texts: record_type, record_id, text, heading int.

    ``heading`` is the number of first lines that are the record's own heading; ``group`` the characters of text that are repaired
    together. Null and empty texts give no rows, repeated rows come out once. A text without noise comes out with its line breaks
    mended and an empty array. An empty table gives an empty result.
    """
    t = texts.select("record_type", "record_id", "text", F.coalesce("heading", F.lit(0)).alias("heading")).filter("text <> ''")
    n = max(1, -(-(t.agg(F.sum(F.length("text"))).first()[0] or 0) // group))
    key = F.xxhash64("record_type", "record_id", "text", "heading")
    groups = t.withColumns({"key": key, "pid": F.pmod(key, F.lit(n)).cast("int")})
    facts = _decisions(groups.repartition(n, "pid"))

    def run(rows: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        known = decisions_of(facts)
        rows = rows.drop_duplicates("key")
        got = [repair_text(x, known, int(h)) for x, h in zip(rows.text, rows.heading)]
        return pd.DataFrame({"record_type": rows.record_type, "record_id": rows.record_id, "repaired": [x for x, _ in got], "noise": [sorted(k) for _, k in got]})

    schema = "record_type string, record_id string, repaired string, noise array<string>"
    return groups.groupBy("pid").cogroup(facts.groupBy("pid")).applyInPandas(run, schema)
