"""Broken prompt and response pairs (P2).

Method: prompt and response are aligned by shingle containment and the longest common subsequence to flag copies, and
the response's opening is aligned in the same way with refusal templates. Empty answers and answers in another language are
told by their visible letters and function words; truncated ones by the evidence of :mod:`corpusloom.llm.cutoff`,
whose corpus are the answers themselves.

Each pair is judged on its own in Arrow batches; the only shuffles are those of the cut-off evidence and of the few
defective pairs.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.cutoff import cut_texts
from corpusloom.llm.language import is_foreign, language_of

#: Tokens of an alignment's templates: plain statements that an answer is declined; topics and reasons are left out.
REFUSALS = (
    "i cannot answer",
    "i can not answer",
    "i cannot answer this question",
    "i can't answer",
    "i am unable to answer",
    "i am not able to answer",
    "i am not able to say",
    "i must decline to answer",
    "i decline to answer",
    "i won't give an opinion here",
    "i do not have a basis for an answer",
    "i don't have enough information to answer",
    "i'm sorry but i am unable to give legal advice",
    "i'm sorry but i cannot help with that",
    "i cannot help with that",
    "i cannot provide legal advice",
    "i'm unable to assist with this request",
    "as a language model i can't comment on",
    "as an ai i cannot",
    "regrettably that is not something i can help with",
    "it would not be appropriate for me to express a view on",
    "it is not possible to answer that",
    "we regret that no reply can be offered",
    "no answer can be given",
    "so no answer is given",
    "insufficient evidence was retrieved to respond reliably",
    "the provided passages do not contain enough information to answer the question",
    "no relevant provision could be found this question cannot be answered from the corpus",
    "this question cannot be answered",
    "this falls outside what i can address",
    "that is beyond the scope of this assistant",
    "unable to determine the sources retrieved concern other matters than",
    "yet nothing in it addresses what was asked and i would rather not speculate",
    "please contact the office directly this system does not respond to requests concerning",
    "abstained confidence below the required level",
    "abstained low confidence",
    "my guidelines prevent me from",
    "my instructions do not allow me to",
    "i would prefer not to discuss",
    "i would prefer not to answer",
    "i would rather not answer",
    "je ne peux pas répondre à cette question",
    "les passages fournis ne permettent pas de répondre",
    "désolé je ne suis pas en mesure de donner un avis juridique",
    "diese frage kann ich nicht beantworten",
    "die vorliegenden textstellen reichen für eine antwort nicht aus",
    "leider darf ich keine rechtsberatung geben",
    "no puedo responder a esta pregunta",
    "los pasajes disponibles no contienen información suficiente",
    "lo siento no me es posible dar asesoramiento jurídico",
    "මට මේ ප්‍රශ්නයට පිළිතුරු දිය නොහැක",
    "සපයා ඇති ඡේදවල ප්‍රමාණවත් තොරතුරු නැත",
    "இந்தக் கேள்விக்கு என்னால் பதிலளிக்க முடியாது",
    "வழங்கப்பட்ட பகுதிகளில் போதிய தகவல் இல்லை",
)
#: Tokens that may stand before the template: a polite opening, what was searched. What follows a declining sentence, a reason or a
#: referral, may have any length, unless it goes on to answer.
BEFORE = 30

_TOKEN = re.compile("[^\\W_](?:[\\w'’̀-ͯऀ-෿‌‍]*[\\ẁ-ͯऀ-෿])?")
# Stand-ins for nothing, without outer marks and letter case; those that are ordinary words too; and beginnings of error messages.
_NOTHING = re.compile(r"(?:null|nil|nan|n/?a|undefined|tbd|tba|tbc|todo|lorem ipsum|insert answer here|no (?:answer|response|text|content|data|output))")
_NOTHING_WORD = re.compile(r"(?:none|not available|unknown|to do|pending|missing|empty|blank|placeholder|void|answer|response|text)")
_FAILURE = re.compile(
    r"^\W*(?:(?:(?:fatal |internal |server |runtime |value |system )*error|traceback|fatal)\b\s*(?:[:\-\[(]|\d|$)|\w+(?:error|exception)\b\s*[:(\[]|unhandled exception|exception (?:in|at|occurred|raised|thrown)\b"
    r"|timeout\b\W*(?:$|(?:error|after|while|waiting|exceeded|reached)\b|[:(\[])|http(?: error)? \d{3}\b|[45]\d\d (?:internal|bad|service|gateway|too many|not found|error)\b|internal server error|(?:service|model|server|upstream) (?:temporarily )?(?:unavailable|offline|timeout|timed out)\b"
    r"|request (?:failed|timed out)\b|rate limit (?:exceeded|reached|hit)\b|fail(?:ed|ure) (?:to )?(?:connect|load|fetch|retriev|generat|pars|process|respond|reach|call|invoke)\w*)",
    re.I,
)
# Contracted forms and what they stand for.
_CONTRACTED = {"can't": "cannot", "won't": "will not", "i'm": "i am", "i'd": "i would", "don't": "do not", "i've": "i have", "isn't": "is not", "couldn't": "could not"}
# Words by which an answer says yes or no.
_YES_NO = {"yes", "no", "yeah", "correct", "oui", "non", "ja", "nein", "sí", "si", "ඔව්", "නැත", "ஆம்", "இல்லை"}
#: Words that may follow a complete statement that no answer is given.
_GOES_ON = set("based from with because as since for in on without due under to about at and or which question questions request requests here so regarding concerning using given until unless if by within outside beyond either query yet but however".split())
#: Words that lead from a reservation to an answer.
_CONTRAST = re.compile(r"\b(?:but|however|nevertheless|nonetheless|that said|still,|mais|cependant|aber|jedoch|pero|sin embargo)\b", re.I)
_VISIBLE = re.compile(r"\w")
_SENTENCE = re.compile(r"[.!?\n।]")


def tokens_of(text: str | None) -> list[str]:
    folded = unicodedata.normalize("NFC", text or "").casefold().replace("’", "'")
    tokens = _TOKEN.findall(folded)
    return [y for x in tokens for y in _CONTRACTED.get(x, x).split()] if "'" in folded else tokens


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, in O(len(a) * len(b) / word size): one bit per token of b."""
    where: dict[str, int] = {}
    for i, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << i
    row = 0
    for w in a:
        x = row | where.get(w, 0)
        row = x & ((x - ((row << 1) | 1)) ^ x)
    return row.bit_count()


def _shingles(t: list[str], k: int) -> list[tuple[str, ...]]:
    return [tuple(t[i : i + k]) for i in range(len(t) - k + 1)]


def is_empty(answer: str | None, question: str | None = None) -> bool:
    """Nothing visible, a stand-in for nothing, or an error message; a stand-in that the question asks about is an answer."""
    if answer is None:
        return True
    if len(list(itertools.islice(_VISIBLE.finditer(answer), 30))) == 30:
        return _FAILURE.search(answer) is not None  # no stand-in has so many letters
    seen = "".join(c for c in answer if unicodedata.category(c)[0] not in "CZ" or c == " ").strip().lower()
    core = re.sub(r"^[^\w]+|[^\w]+$", "", seen)
    if not core or _NOTHING.fullmatch(core) or _FAILURE.search(answer):
        return True
    return _NOTHING_WORD.fullmatch(core) is not None and not set(tokens_of(core)) <= set(tokens_of(question)) - {"answer", "response", "text"}


def is_copy(question: list[str], answer: list[str]) -> bool:
    """The answer has the question's tokens in order, maybe repeatedly, and next to nothing else; a yes or no of its own is an answer."""
    if answer and answer[0] in _YES_NO and answer[0] not in question[:1]:
        return False
    if len(question) < 3 or len(answer) < 3:
        return question == answer and len(answer) > 0
    asked = set(zip(question, question[1:], question[2:]))
    mine = list(zip(answer, answer[1:], answer[2:]))
    inside = sum(s in asked for s in mine) / len(mine)
    if inside < 0.4:
        return False
    common = lcs(question, answer)
    if common >= 0.85 * len(question) and len(answer) - common <= 4:
        return True
    if common >= 0.8 * len(question) and inside >= 0.75:
        return True
    return inside >= 0.95 and len(answer) >= max(4, len(question) // 2)


class Templates:
    """Templates by their token pairs."""

    def __init__(self, templates: tuple[str, ...]) -> None:
        self.tokens = [tokens_of(t) for t in templates]
        self.pairs: dict[tuple[str, ...], list[int]] = {}
        for i, t in enumerate(self.tokens):
            for s in set(_shingles(t, 2)):
                self.pairs.setdefault(s, []).append(i)

    def matches(self, text: str, before: int = BEFORE) -> bool:
        """A sentence of the text, with at most ``before`` tokens ahead of it, contains a template by most of its shingles, in order, as
        the clause that governs: a short template is followed by the clause's end or by a word that cannot complete it otherwise,
        and nothing behind it goes on to answer."""
        if not self._near(tokens_of(text)):
            return False
        ahead, start = 0, 0
        for stop in [*(m.end() for m in _SENTENCE.finditer(text)), len(text)]:
            part, start_of = text[start:stop], start
            start = stop
            # a template may reach into the next sentence
            answer = tokens_of(part)
            if not answer:
                continue
            reach = text[start_of : next((m.end() for m in _SENTENCE.finditer(text, stop)), len(text))]
            longer = tokens_of(reach)
            hits: dict[int, int] = {}
            for s in set(_shingles(longer, 2)):
                for i in self.pairs.get(s, ()):
                    hits[i] = hits.get(i, 0) + 1
            for i, n in hits.items():
                t = self.tokens[i]
                need = 1.0 if len(t) <= 5 else 0.7
                if n >= need * (len(t) - 1) and lcs(t, longer) >= (1.0 if len(t) <= 5 else 0.85) * len(t) and self._governs(t, reach, longer) and not _answers(text[start_of:], t):
                    return True
            ahead += len(answer)
            if ahead > before:
                break
        return False

    def _near(self, tokens: list[str]) -> bool:
        """Whether any template has the shingles it needs in the whole text: without them no sentence can contain it."""
        hits: dict[int, int] = {}
        for i in itertools.chain.from_iterable(map(self.pairs.__getitem__, self.pairs.keys() & set(zip(tokens, tokens[1:])))):
            hits[i] = hits.get(i, 0) + 1
        return any(n >= (1.0 if len(self.tokens[i]) <= 5 else 0.7) * (len(self.tokens[i]) - 1) for i, n in hits.items())

    @staticmethod
    def _governs(t: list[str], text: str, tokens: list[str]) -> bool:
        if len(t) > 8:
            return True
        at = next((i for i in range(len(tokens) - len(t) + 1) if tokens[i : i + len(t)] == t), None)
        if at is None or t[-1] not in ("that", "answer", "given", "answered"):
            return True
        rest = tokens[at + len(t) : at + len(t) + 1]
        if not rest or rest[0] in _GOES_ON or rest[0] in ("this", "that", "your", "the", "it", "any", "reliably", "safely", "directly"):
            return True
        return re.search(rf"{re.escape(t[-1])}\W*[.!?;:,—–\n-]", text, re.I) is not None


def _answers(rest: str, template: list[str]) -> bool:
    """What follows a declining clause goes on to answer: a contrast, and then a clause with a number, a section or a duty."""
    for m in _CONTRAST.finditer(rest):
        if lcs(template, tokens_of(rest[: m.start()])) < 0.85 * len(template):
            continue
        after = tokens_of(rest[m.end() :])
        if len(after) >= 8 and (any(x[0].isdigit() for x in after) or {"shall", "must", "section", "article", "may", "doit", "muss", "debe"} & set(after)):
            return True
    return False


_REFUSALS = Templates(REFUSALS)


_asked_tokens = functools.lru_cache(20_000)(lambda question: tokens_of(question))
_asked_language = functools.lru_cache(20_000)(language_of)


def defect_of(question: str | None, answer: str | None) -> str | None:
    """'empty', 'copy', 'refusal', 'other_language' or None; cut answers are found apart."""
    if is_empty(answer, question):
        return "empty"
    a = tokens_of(answer)
    if question and is_copy(_asked_tokens(question), a):
        return "copy"
    if _REFUSALS.matches(unicodedata.normalize("NFC", answer)):
        return "refusal"
    if question:
        asked, told = _asked_language(question), language_of(answer)
        if asked and (told and asked != told or told is None and is_foreign(answer, asked)):
            return "other_language"
    return None


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """(key, defect) of the unusable pairs; pairs: key string, source string, question string, answer string.

    Null answers are 'empty'; without a question an answer can be no copy and in no other language. A pair gets its
    first defect in the order empty, copy, refusal, other_language, truncated. Repeated rows count once. An empty
    table gives an empty result.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [defect_of(q, a) for q, a in zip(b.column("question").to_pylist(), b.column("answer").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(found, pa.string())], ["key", "defect"])

    judged = pairs.select("key", "question", "answer").mapInArrow(judge, "key string, defect string").filter("defect IS NOT NULL")
    cut = cut_texts(pairs.select("key", "source", F.col("answer").alias("text"))).filter("cut").select("key", F.lit("truncated").alias("defect"))
    ranked = judged.withColumn("rank", F.lit(0)).unionByName(cut.withColumn("rank", F.lit(1)))
    return ranked.groupBy("key").agg(F.min_by("defect", "rank").alias("defect"))
