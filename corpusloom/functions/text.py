"""Scalar text functions as column expressions; all of them stay inside the JVM.

White space is space, tab, line feed, vertical tab, form feed and carriage return. Null in, null out, unless stated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OUTER = ".,;:!?'\""

# Abbreviations of queries; matched per word, without letter case.
ABBREVIATIONS = {"sec": "section", "sec.": "section", "s.": "section", "ch": "chapter", "ch.": "chapter", "pt": "part", "pt.": "part", "para": "paragraph", "para.": "paragraph", "act": "Act", "no": "number", "no.": "number"}
# Domain terms looked for in queries.
DOMAIN_TERMS = ["criminal", "civil", "contract", "tort", "property", "evidence", "procedure", "penal", "administrative", "constitutional", "labor", "labour"]
# Stop words of the containment and of the Jaccard overlap.
CONTAINMENT_STOP = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "shall", "will", "that", "this", "these", "those"]
JACCARD_STOP = ["the", "a", "an", "and", "or", "in", "of", "to", "is", "shall", "be", "by", "that", "this", "for", "with", "as"]
# Legal phrases and their plain wording, applied in this order.
PLAIN_WORDING = [
    ("herein", "in this"), ("hereinafter", "from now on"), ("wherein", "where"), ("whereas", "since"), ("forthwith", "immediately"),
    ("notwithstanding", "despite"), ("pursuant to", "under"), ("prior to", "before"), ("subsequent to", "after"), ("provided that", "if"),
    ("shall", "must"), ("may", "can"), ("deemed", "considered"), ("aforesaid", "mentioned above"), ("thereafter", "after that"),
]
# Keywords by domain, in order of precedence.
DOMAIN_KEYWORDS = {
    "criminal": ["theft", "murder", "assault", "robbery", "rape", "burglary", "fraud", "kidnapping", "extortion", "bribery", "criminal", "penal code", "offence", "offense", "punishment", "penalty", "imprisonment", "fine", "accused", "crime", "guilty", "conviction"],
    "civil": ["contract", "tort", "negligence", "damages", "breach", "civil procedure", "plaint", "defendant", "plaintiff", "injunction", "declaration", "suit", "action", "claim", "liability", "compensation", "settlement"],
    "evidence": ["evidence", "witness", "testimony", "hearsay", "admissible", "burden of proof", "presumption", "documentary evidence", "oral evidence", "circumstantial", "expert evidence", "evidence ordinance", "proof", "examination", "cross-examination"],
    "constitutional": ["constitution", "fundamental rights", "parliament", "supreme court", "president", "article", "constitutional", "bill of rights", "amendment", "legislature", "judicial review", "separation of powers", "sovereignty"],
    "property": ["property", "land", "ownership", "title", "deed", "mortgage", "lease", "tenancy", "easement", "transfer", "conveyance", "immovable property", "real estate", "possession"],
    "family": ["marriage", "divorce", "custody", "maintenance", "alimony", "adoption", "inheritance", "succession", "will", "estate", "family", "spouse", "children", "parent", "guardian", "matrimonial", "kandyan law", "thesawalamai", "muslim law"],
    "administrative": ["administrative", "public service", "government", "license", "permit", "regulation", "authority", "tribunal", "appeal", "judicial review", "writ", "mandamus", "certiorari"],
    "commercial": ["company", "corporation", "business", "partnership", "commercial", "trade", "banking", "finance", "securities", "insolvency", "bankruptcy", "shareholder", "director"],
    "labor": ["employment", "labor", "labour", "employee", "employer", "termination", "unfair dismissal", "workplace", "salary", "wages", "benefits", "trade union", "industrial dispute"],
}
# Statutes that stand for a domain when no keyword occurs.
DOMAIN_STATUTES = {"criminal": ["penal code", "penal ordinance"], "civil": ["civil procedure"], "evidence": ["evidence ordinance"], "constitutional": ["constitution"]}
# Patterns (2 points each) and substrings (half a point each) of the query types, in order of precedence.
QUERY_TYPE_SIGNS = {
    "procedural": (
        ["how\\s+to", "how\\s+do\\s+i", "how\\s+can\\s+i", "what\\s+is\\s+the\\s+procedure", "what\\s+are\\s+the\\s+steps", "what\\s+process", "file\\s+a", "apply\\s+for", "submit"],
        ["procedure", "process", "steps", "file", "submit", "apply", "register", "lodge", "appeal", "petition", "plaint"],
    ),
    "factual": (
        ["what\\s+is", "what\\s+are", "what\\s+does", "define", "definition\\s+of", "meaning\\s+of", "explain", "who\\s+is", "when\\s+is", "where\\s+is"],
        ["definition", "meaning", "is", "are", "what", "explain", "describe", "penalty", "punishment", "provision"],
    ),
    "interpretive": (
        ["does\\s+this", "is\\s+this", "would\\s+this", "can\\s+this\\s+be\\s+considered", "qualify\\s+as", "count\\s+as", "apply\\s+to", "under\\s+which", "which\\s+law"],
        ["interpret", "applicable", "apply", "qualify", "consider", "constitute", "classify", "categorize"],
    ),
    "advisory": (
        ["should\\s+i", "what\\s+should", "can\\s+i", "may\\s+i", "could\\s+i", "what\\s+are\\s+my\\s+options", "what\\s+can\\s+i\\s+do", "advice", "recommend", "what\\s+happens\\s+if"],
        ["should", "advice", "recommend", "options", "rights", "remedy", "recourse", "action", "do"],
    ),
}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\\s+", " "))


def clean_text(c: Column) -> Column:
    """All white space flattened, then everything outside ASCII deleted, in this order."""
    return F.regexp_replace(normalize_whitespace(c), "[^\\x00-\\x7F]+", "")


def first_match(c: Column, *patterns: str, group: int = 1) -> Column:
    """The group of the first pattern that occurs, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, group), F.lit("")) for p in patterns])


def section_number(c: Column) -> Column:
    part = "(\\d+[A-Z]?(?:\\(\\d+\\)(?:\\([a-z]\\))?)?)"
    return first_match(c, f"(?i)Section\\s+{part}", f"(?i)Sec\\.\\s+{part}", f"(?i)^{part}\\.")


def act_reference(c: Column) -> Column:
    """struct(name, number, year) of 'Name (Act No. n of yyyy)', null if there is none."""
    p = "([^(]+)\\s*\\(Act\\s+No\\.\\s*(\\d+)\\s+of\\s+(\\d{4})\\)"
    return F.when(c.rlike(p), F.struct(strip(F.regexp_extract(c, p, 1)).alias("name"), F.regexp_extract(c, p, 2).alias("number"), F.regexp_extract(c, p, 3).alias("year")))


def citation_label(act: Column, section: Column, year: Column) -> Column:
    return F.concat(act, F.lit(", Section "), section, F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(""))


def parse_date(c: Column) -> Column:
    """The first of yyyy-mm-dd, dd/mm/yyyy and dd-mm-yyyy that fits, as a date."""
    full = c.rlike("^(\\d{4}-\\d{1,2}-\\d{1,2}|\\d{1,2}[/-]\\d{1,2}[/-]\\d{4})$")
    return F.when(full, F.coalesce(*[F.try_to_timestamp(c, F.lit(p)).cast("date") for p in ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy")]))


def tokens(c: Column) -> Column:
    """Lower case, split at white space, outer punctuation removed, empty tokens dropped; the empty array for null."""
    parts = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), "\\s+"), lambda w: F.btrim(w, F.lit(_OUTER)))
    return F.filter(parts, lambda w: w != "")


def article_id(c: Column) -> Column:
    return F.regexp_replace(c, "_(CHUNK|SUBSEC)_.*$", "")


def base_id(c: Column) -> Column:
    return F.substring_index(c, "_CHUNK_", 1)


def expand_abbreviations(c: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.array_join(F.transform(F.split(normalize_whitespace(c), " "), lambda w: F.coalesce(F.element_at(pairs, F.lower(w)), w)), " ")


def query_type(c: Column) -> Column:
    """The first that applies; questions for who, what, which and where are factual whatever else they contain."""
    q = F.lower(c)
    return (
        F.when(q.rlike("\\b(what|who|which|where)\\b"), "factual")
        .when(q.rlike("\\b(how|when|process|procedure|step)\\b"), "procedural")
        .when(q.rlike("\\b(mean|means|interpret|definition|define)\\b"), "interpretive")
        .when(F.regexp_count(c, F.lit("[Ss]ection\\s+\\d+")) > 1, "cross_referenced")
        .otherwise("general")
    )


def section_references(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[Ss]ection\\s+(\\d+[A-Z]?(?:\\([a-z0-9]+\\))?)"), F.lit(1))


def article_references(c: Column) -> Column:
    """Distinct article numbers in their order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("(?i)Article\\s+(\\d+[A-Z]?)"), F.lit(1)))


def years(c: Column, compat: bool = False) -> Column:
    """Years from 1900 to 2099; ``compat`` gives only their first two digits."""
    return F.regexp_extract_all(c, F.lit("\\b((?:19|20)\\d{2})\\b" if not compat else "\\b(19|20)\\d{2}\\b"), F.lit(1))


def domain_terms(c: Column) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in DOMAIN_TERMS]), lambda t: F.lower(c).contains(t))


def classify_query(c: Column) -> Column:
    """struct(query_type, confidence): the best scored type, the first of equals; 'general' with 0.3 without any sign."""
    q = F.lower(c)
    scores = {t: sum([F.when(q.rlike(f"\\b{p}\\b"), 2.0).otherwise(0.0) for p in ps] + [F.when(q.contains(k), 0.5).otherwise(0.0) for k in ks], F.lit(0.0)) for t, (ps, ks) in QUERY_TYPE_SIGNS.items()}
    return _best(scores)


def identify_domain(c: Column) -> Column:
    """struct(name, confidence): whole-word keyword counts by domain, statutes only where no keyword occurs."""
    q = F.lower(c)
    counts = {d: sum([F.regexp_count(q, F.lit("\\b" + k.replace("-", "\\-") + "\\b")) for k in ks], F.lit(0)).cast("double") for d, ks in DOMAIN_KEYWORDS.items()}
    statutes = {d: F.when(reduce(lambda a, b: a | b, [q.contains(s) for s in DOMAIN_STATUTES.get(d, ["\x00"])]), 5.0).otherwise(0.0) for d in DOMAIN_KEYWORDS}
    by_word = _best(counts)
    return F.when(by_word["name"] == "general", _best(statutes)).otherwise(by_word)


def _best(scores: dict[str, Column]) -> Column:
    """The name of the highest score, the first of equals, with its share. The scores are bound once, not repeated."""
    names = F.array(*[F.lit(t) for t in scores])

    def pick(a: Column) -> Column:
        top, total = F.array_max(a), F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
        return F.struct(F.when(top <= 0, "general").otherwise(F.element_at(names, F.array_position(a, top).cast("int"))).alias("name"), F.when(top <= 0, 0.3).otherwise(top / total).alias("confidence"))

    return F.element_at(F.transform(F.array(F.array(*scores.values())), pick), 1)


def has_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def plain_wording(c: Column) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, f"(?i)\\b{r[0]}\\b", r[1]), PLAIN_WORDING, c)


def content_words(c: Column, stop: list[str]) -> Column:
    """Distinct lower-case words of more than two characters that are no stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "\\s+"), lambda w: (F.length(w) > 2) & ~w.isin(stop)))


def containment(claim: Column, evidence: Column) -> Column:
    a, b = content_words(claim, CONTAINMENT_STOP), content_words(evidence, CONTAINMENT_STOP)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def jaccard(left: Column, right: Column) -> Column:
    a, b = content_words(left, JACCARD_STOP), content_words(right, JACCARD_STOP)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def edit_accuracy(a: Column, b: Column, most: int = 5000) -> Column:
    """1 - distance / longer length over the first ``most`` characters: 1 for two empty texts, 0 for one."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    p, q = F.substring(x, 1, most), F.substring(y, 1, most)
    return F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).otherwise(1.0 - F.levenshtein(p, q) / F.greatest(F.length(p), F.length(q)))


def scan_quality(c: Column) -> Column:
    """1 minus a tenth of the suspicious patterns per 100 characters, at least 0; 0 for null and for fewer than 100 characters."""
    signs = ["[^\\p{L}\\p{N}_\\s.,;:!?()\\[\\]{}'\"/\\-]{3,}", "\\b[a-z]{1,2}\\d{1,2}[a-z]{1,2}\\d{1,2}\\b", "\\b[IlO0]{4,}\\b"]
    n = sum([F.regexp_count(c, F.lit(s)) for s in signs], F.lit(0))
    return F.when(F.length(F.coalesce(c, F.lit(""))) < 100, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - n / (F.length(c) / 100.0) / 10.0))


def valid_section(c: Column) -> Column:
    return F.coalesce(strip(c).rlike("^[0-9]+[A-Z]?(\\([0-9]+\\))?(\\([a-z]\\))?$"), F.lit(False))


def act_filter(c: Column) -> Column:
    """null: no act is meant; '': the constitution; else the act's name. An article without the word section means the constitution."""
    q = F.lower(c)
    return (
        F.when(q.rlike("\\bconstitution\\b"), "")
        .when(q.rlike("\\bpenal\\s+code\\b"), "Penal Code")
        .when(q.rlike("\\bcivil\\s+procedure\\s+code\\b"), "Civil Procedure Code")
        .when(q.rlike("\\bevidence\\s+ordinance\\b"), "Evidence Ordinance")
        .when(q.rlike("\\bcriminal\\s+procedure\\s+code\\b"), "Criminal Procedure Code")
        .when(q.rlike("article\\s+\\d+") & ~q.rlike("\\bsection\\b"), "")
    )


def act_passes(wanted: Column, act: Column) -> Column:
    """Whether a passage of ``act`` passes the filter ``wanted``; null passes all."""
    a = F.lower(F.coalesce(act, F.lit("")))
    return wanted.isNull() | F.when(wanted == "", (a == "") | a.contains("constitution")).otherwise(a.contains(F.lower(wanted)))


# Abbreviations that a parsed question is freed of, as substrings and in this order, and beginnings that tell its kind.
PARSED_ABBREVIATIONS = [(" pc ", " penal code "), (" cpc ", " civil procedure code "), (" eo ", " evidence ordinance "), ("s.", "section "), ("sec.", "section "), ("art.", "article ")]
QUESTION_STARTS = [("factual", ["what is", "what are", "what does"]), ("procedural", ["how to", "how do i", "how can"]), ("interpretive", ["why", "when", "where"]), ("advisory", ["can i", "could i", "may i", "should i", "would"]), ("factual", ["is", "are", "was", "were"])]


def parsed_query(c: Column) -> Column:
    """Lower case, flat white space, abbreviations replaced wherever their letters stand."""
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), PARSED_ABBREVIATIONS, normalize_whitespace(F.lower(c)))


def question_kind(c: Column) -> Column:
    low, out = F.lower(c), F.lit("general")
    for name, starts in reversed(QUESTION_STARTS):
        out = F.when(reduce(lambda a, b: a | b, [low.startswith(x) for x in starts]), name).otherwise(out)
    return out
