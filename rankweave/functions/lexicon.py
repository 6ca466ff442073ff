"""Lexicons: the term lists that query understanding and scoring use.

A ``Lexicon`` is plain data. Operators turn it into literal array columns and
evaluate it with higher-order functions, so matching a query against a
lexicon is a narrow projection (no join, no shuffle). A lexicon is bounded by
construction; ``Lexicon.check_size`` enforces the bound before it is inlined.

``reference_lexicon()`` holds the published vocabulary of the original
system. ``derive_lexicon(part)`` builds a lexicon of the same shape from a
catalogue's own vocabulary (used for the driver tables, whose item names are
"adjective noun" pairs).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LEXICON_TERMS = 100_000


@dataclass(frozen=True)
class Lexicon:
    # D3: (concept, variants) in order; a hit on any variant adds all variants.
    concepts: tuple = ()
    # (role, keywords) in order.
    roles: tuple = ()
    # (trigger terms, category tags) in order; tags of every hit rule are appended (a bag).
    tag_rules: tuple = ()
    # (trigger terms, job-level terms) in order.
    job_rules: tuple = ()
    # Boost terms for the basic retriever.
    boost_terms: tuple = ()
    # Whole-token boost vocabulary for the boosted retriever.
    token_terms: tuple = ()
    # Fallback re-rank terms.
    fallback_skills: tuple = ()
    fallback_roles: tuple = ()
    # level rules (query terms, name terms).
    entry_query: tuple = ()
    entry_name: tuple = ()
    senior_query: tuple = ()
    senior_name: tuple = ()
    # words ignored when counting query/name word overlap.
    stopwords: tuple = ()
    # H8: (label, terms) patterns counted over low-recall queries.
    miss_patterns: tuple = ()
    extra: dict = field(default_factory=dict)

    def check_size(self, limit: int = MAX_LEXICON_TERMS) -> "Lexicon":
        n = (sum(1 + len(v) for _, v in self.concepts) + sum(1 + len(v) for _, v in self.roles)
             + sum(len(a) + len(b) for a, b in self.tag_rules)
             + len(self.boost_terms) + len(self.token_terms))
        if n > limit:
            raise ValueError(f"lexicon has {n} terms, above the inline bound {limit}")
        return self


# Fixed values of the original system, stated in its order: concept expansions,
# role keywords, category-preference rules, job-level rules, boost lists,
# fallback lists, level rules and stopwords.
_REFERENCE = dict(
    concepts=(
        ("java", ("java", "j2ee", "j2se", "jdk", "jvm", "spring", "hibernate", "core java", "automata")),
        ("python", ("python", "django", "flask", "pandas", "numpy", "data science")),
        ("sql", ("sql", "database", "mysql", "postgresql", "oracle", "query", "sql server", "ssas")),
        ("javascript", ("javascript", "javascript", "java script", "js", "node", "react", "angular", "vue", "frontend")),
        ("html", ("html", "css", "htmlcss", "web", "frontend", "markup")),
        ("css", ("css", "html", "htmlcss", "web", "frontend", "styling")),
        ("selenium", ("selenium", "automation", "testing", "qa", "web automation", "test automation")),
        ("excel", ("excel", "spreadsheet", "ms excel", "microsoft excel", "excel 365")),
        ("data analyst", ("data analyst", "data analysis", "analytics", "bi", "business intelligence", "tableau")),
        ("developer", ("developer", "programmer", "coder", "software engineer", "engineer", "technology")),
        ("sales", ("sales", "selling", "salesperson", "account manager", "entry level sales", "sales representative")),
        ("manager", ("manager", "management", "supervisor", "lead", "director", "marketing manager")),
        ("admin", ("admin", "administrative", "administrator", "clerical", "office", "assistant", "bank administrative")),
        ("leadership", ("leadership", "leader", "executive", "coo", "ceo", "cfo", "enterprise leadership")),
        ("consultant", ("consultant", "consulting", "advisory", "professional", "advisor")),
        ("qa", ("qa", "quality assurance", "testing", "test", "manual testing", "automation testing")),
        ("marketing", ("marketing", "digital marketing", "advertising", "digital advertising", "brand")),
        ("communication", ("communication", "verbal", "written", "english", "language", "interpersonal", "business communication")),
        ("personality", ("personality", "behavior", "behavioral", "traits", "opq", "opq32", "occupational personality")),
        ("cognitive", ("cognitive", "reasoning", "aptitude", "ability", "intelligence", "inductive", "deductive")),
        ("numerical", ("numerical", "math", "mathematics", "quantitative", "arithmetic", "calculation", "verify numerical")),
        ("verbal", ("verbal", "language", "comprehension", "reading", "writing", "verify verbal")),
        ("inductive", ("inductive", "inductive reasoning", "pattern recognition", "abstract reasoning")),
        ("entry", ("entry", "entry level", "graduate", "junior", "fresher", "new graduate")),
        ("senior", ("senior", "experienced", "advanced", "professional", "expert")),
    ),
    roles=(
        ("developer", ("developer", "programmer", "coder", "engineer", "software")),
        ("analyst", ("analyst", "data analyst", "business analyst", "data")),
        ("manager", ("manager", "supervisor", "lead", "director", "management")),
        ("admin", ("admin", "administrative", "administrator", "assistant", "clerical")),
        ("sales", ("sales", "salesperson", "account manager", "selling")),
        ("executive", ("executive", "coo", "ceo", "cfo", "leadership", "senior executive")),
        ("consultant", ("consultant", "consulting", "advisor", "advisory")),
        ("professional", ("professional", "specialist", "expert")),
    ),
    tag_rules=(
        (("personality", "behavior", "behavioral"), ("Personality & Behavior",)),
        (("cognitive", "aptitude", "reasoning"), ("Ability & Aptitude",)),
        (("knowledge", "skill", "technical"), ("Knowledge & Skills",)),
        (("communication", "verbal", "english"), ("Ability & Aptitude",)),
        (("numerical", "math", "quantitative"), ("Ability & Aptitude",)),
        (("situational", "judgement", "judgment"), ("Biodata & Situational Judgement",)),
        (("consultant", "professional"), ("Personality & Behavior", "Ability & Aptitude", "Competencies")),
    ),
    job_rules=(
        (("entry", "graduate"), ("entry level", "junior", "graduate")),
        (("senior", "experienced"), ("senior", "experienced", "professional")),
        (("manager",), ("management",)),
        (("analyst",), ("data analysis",)),
    ),
    boost_terms=(
        "java", "python", "javascript", "sql", "excel", "data", "analyst",
        "developer", "engineer", "sales", "manager", "admin", "leadership",
        "verbal", "numerical", "cognitive", "personality", "seo", "marketing",
        "communication", "english", "programming", "coding", "software",
    ),
    token_terms=(
        "java", "python", "sql", "javascript", "html", "css", "selenium", "excel",
        "c#", ".net", "ruby", "php", "swift", "kotlin", "scala", "typescript",
        "angular", "react", "vue", "node", "spring", "django", "flask",
        "sales", "developer", "manager", "analyst", "engineer", "admin", "administrative",
        "leadership", "executive", "consultant", "qa", "marketing", "graduate", "entry",
        "cognitive", "personality", "numerical", "verbal", "reasoning", "aptitude",
        "communication", "behavioral", "inductive", "deductive", "mechanical",
    ),
    fallback_skills=("java", "python", "sql", "javascript", "excel", "data", "analyst"),
    fallback_roles=("developer", "analyst", "manager", "admin", "sales", "executive"),
    entry_query=("entry", "graduate", "junior", "0-2", "0-3"),
    entry_name=("entry", "junior", "level"),
    senior_query=("senior", "experienced", "5+", "years"),
    senior_name=("senior", "advanced", "professional"),
    stopwords=("the", "a", "an", "for", "and", "or", "to", "in", "of", "is", "are"),
    miss_patterns=(
        ("consultant", ("consultant",)),
        ("qa", ("qa", "quality")),
        ("marketing", ("marketing",)),
        ("manager", ("manager",)),
    ),
)


def reference_lexicon() -> Lexicon:
    return Lexicon(**_REFERENCE)


# Fixed values of the derived test lexicon that do not come from the data:
# one multi-category rule (like the original's consultant rule).
DERIVED_MULTI_RULE = (("kit", "grade"), ("STANDARD", "PROMO"))


def derive_lexicon(part: DataFrame, max_terms: int = MAX_LEXICON_TERMS) -> Lexicon:
    """Lexicon from a catalogue vocabulary of "adjective noun" item names.

    concepts  = nouns, variants (noun, noun + 's')
    roles     = adjectives, keyword = the adjective
    tag rules = one per category (lower-case category -> category) plus DERIVED_MULTI_RULE
    boost and fallback lists = nouns and adjectives
    The level rules, job rules and stopwords are the reference ones.

    The vocabulary is computed by Spark (distinct with map-side combine); only
    the distinct words, whose count is checked, come to the driver.
    """
    words = (part.select(F.lower(F.element_at(F.split("p_name", " "), 1)).alias("adj"),
                         F.lower(F.element_at(F.split("p_name", " "), -1)).alias("noun"),
                         F.col("p_type").alias("ptype")))
    vocab = (words.select(F.lit("adj").alias("k"), F.col("adj").alias("w"))
             .unionByName(words.select(F.lit("noun").alias("k"), F.col("noun").alias("w")))
             .unionByName(words.select(F.lit("type").alias("k"), F.col("ptype").alias("w")))
             .where(F.col("w").isNotNull() & (F.col("w") != ""))
             .distinct())
    n = vocab.count()
    if n > max_terms:
        raise ValueError(f"vocabulary of {n} words exceeds the inline bound {max_terms}")
    rows = vocab.collect()
    adjs = sorted({r.w for r in rows if r.k == "adj"})
    nouns = sorted({r.w for r in rows if r.k == "noun"})
    types = sorted({r.w for r in rows if r.k == "type"})
    ref = _REFERENCE
    return Lexicon(
        concepts=tuple((n_, (n_, n_ + "s")) for n_ in nouns),
        roles=tuple((a, (a,)) for a in adjs),
        tag_rules=tuple(((t.lower(),), (t,)) for t in types) + (DERIVED_MULTI_RULE,),
        job_rules=ref["job_rules"],
        boost_terms=tuple(nouns + adjs),
        token_terms=tuple(nouns + adjs),
        fallback_skills=tuple(nouns),
        fallback_roles=tuple(adjs),
        entry_query=ref["entry_query"], entry_name=ref["entry_name"],
        senior_query=ref["senior_query"], senior_name=ref["senior_name"],
        stopwords=ref["stopwords"],
        miss_patterns=tuple((n_, (n_,)) for n_ in nouns),
    ).check_size(max_terms)
