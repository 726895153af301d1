"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are not terms.
STOP_WORDS = "a an and are as at be by for from how in is it of on or that the this to was what when where which who with".split()

#: Patterns of credentials in free text, and of credential-named keys.
SECRET_PATTERNS = (
    r"\bAKIA[0-9A-Z]{16}\b",
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"(?i)\b(?:password|passwd|token|api[_ -]?key|secret)\b\s*[:=]\s*(?:['\"])?[^\s,;]{4,}",
)
CREDENTIAL_KEY = r"(?i)^(?:api[_-]?key|token|password|passwd|secret)$"

#: Reporting classes of hosts, first match wins.
SOURCE_CLASSES = (
    ("primary_authority", (r"\.gov$", r"\.gov\.")),
    ("strong_secondary", (r"\.edu$", "archive", "museum", r"loc\.gov")),
    ("reference", ("wikipedia", "britannica")),
    ("community_or_folklore", ("reddit", "forum", "blogspot")),
    ("retail", ("totalwine", "reservebar", "drizly")),
)
EVIDENCE_TYPES = {"primary_authority": "verified_fact", "strong_secondary": "supported_interpretation", "community_or_folklore": "unverified_story"}
CLAIM_VERBS = r"(?i)\b(is|was|were|became|requires?|began|first)\b"


def terms(text: Column) -> Column:
    """Distinct lower-case runs of a-z and 0-9, longer than 1, without stop words; null has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS)))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """White-space words."""
    return F.size(words(text))


def regex_token_count(text: Column) -> Column:
    """Word runs, with inner . / : and - joining them."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+(?:[./:-][\p{L}\p{N}_]+)*"), 0))


def truncate_tokens(text: Column, n: Column) -> Column:
    """The first n words; none for n <= 0."""
    return F.when(n <= 0, "").otherwise(F.array_join(F.slice(words(text), F.lit(1), F.greatest(n, F.lit(0))), " "))


def naive_summary(text: Column, n: Column) -> Column:
    """Four characters a token, and a mark."""
    return F.concat(F.substring(text, F.lit(1), n * 4), F.lit(" ...[truncated]"))


def component_summary(text: Column, n: Column) -> Column:
    return F.when(token_count(text) <= n, text).otherwise(F.substring(text, F.lit(1), n * 4))


def jaccard(left: Column, right: Column, empty: float = 0.0) -> Column:
    """Of two distinct arrays; `empty` if both are."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, empty).otherwise(F.size(F.array_intersect(left, right)) / union)


def normalize(text: Column) -> Column:
    """Case-folded (with the sharp s as ss; other folds of several characters are left out), white space collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"(?U)\s+", " "))


def normalized_hash(text: Column) -> Column:
    return F.sha2(normalize(text), 256)


def embedding_text(kind: Column, content: Column, tags: Column, task: Column) -> Column:
    extra = F.when(kind == "AgentGoalComponent", F.concat(F.lit("Goal: "), content)).when(kind == "TaskSummaryComponent", F.concat(F.lit("Task: "), F.coalesce(task, F.lit("Unknown")))).when(kind == "LongTermMemoryComponent", F.concat(F.lit("Learning: "), content))
    tag_line = F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", ")))
    return F.concat(F.concat_ws("\n", content, F.concat(F.lit("Type: "), kind), tag_line, extra), F.lit("\n"))


def render(kind: Column, payload: Column) -> Column:
    """Content of a typed memory; `payload` is a struct with the fields that the types use."""
    p = payload.getField
    task = F.concat(F.lit("Task: "), p("name"), F.lit("\nSummary: "), p("text"))
    user = F.concat(F.lit("User: "), p("name"), F.lit("\nPreferences: "), F.array_join(F.transform(F.map_entries(p("preferences")), lambda e: F.concat(e.key, F.lit(": "), e.value)), ", "))
    long = F.concat(F.lit("["), p("stamp"), F.lit("] From "), p("name"), F.lit(": "), p("text"))
    derived = F.concat(F.lit("Derived Memory ("), p("name"), F.lit("): "), p("text"))
    session = F.concat(F.lit("Agent Session: "), p("name"), F.lit("\nAgent ID: "), p("agent"), F.lit("\nStatus: "), F.when(p("success"), "SUCCESS").otherwise("FAILED"), F.lit("\nDuration: "), F.format_string("%.1f", p("minutes")), F.lit(" minutes\nSummary: "), p("text"), F.lit("\nTimestamp: "), p("stamp"))
    return F.when(kind == "TaskSummaryComponent", task).when(kind == "UserProfileComponent", user).when(kind == "LongTermMemoryComponent", long).when(kind == "AgentSessionComponent", session).otherwise(derived)


def preview(id_: Column, kind: Column, score: Column, tokens: Column, tags: Column, content: Column) -> Column:
    head = F.concat(F.lit("["), id_, F.lit("] "), kind, F.lit("\n  Score: "), F.format_string("%.2f", score), F.lit(" | Tokens: "), tokens.cast("string"))
    return F.concat(head, F.lit("\n  Tags: "), F.array_join(tags, ", "), F.lit("\n  Preview: "), F.replace(F.substring(content, 1, 80), F.lit("\n"), F.lit(" ")), F.lit("...\n"))


def slugify(text: Column) -> Column:
    slug = F.left(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(64))
    return F.when(slug == "", "research-project").otherwise(slug)


def secret_flags(text: Column) -> Column:
    """Which of the three patterns stand in the text."""
    return F.array(*[F.coalesce(F.rlike(text, F.lit(p)), F.lit(False)) for p in SECRET_PATTERNS])


def credential_entry(entries: Column) -> Column:
    """Whether a map has a credential-named key with a value of four characters or more."""
    return F.exists(F.map_entries(entries), lambda e: e.key.rlike(CREDENTIAL_KEY) & (F.length(F.trim(e.value)) >= 4))


def classify_source(url: Column) -> Column:
    """Class of a source by its host (port and user included)."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")))
    out = None
    for name, patterns in SOURCE_CLASSES:
        hit = F.lit(False)
        for pattern in patterns:
            hit = hit | host.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("web_secondary")


def sentences(text: Column) -> Column:
    """Cut after . ! or ? and white space, white space collapsed."""
    return F.transform(F.split(text, r"(?<=[.!?])(?U)\s+"), lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))


def is_claim(sentence: Column) -> Column:
    first = F.substring(sentence, 1, 1)
    return F.length(sentence).between(60, 500) & (first != F.lower(first)) & sentence.rlike(CLAIM_VERBS)


def evidence_type(source_class: Column) -> Column:
    out = F.lit("source_claim")
    for name, kind in EVIDENCE_TYPES.items():
        out = F.when(source_class == name, kind).otherwise(out)
    return out


def domain_hash(domain: str, payload: Column) -> Column:
    """sha256 of a domain, a zero byte and a canonical payload of strings and integers."""
    return F.sha2(F.concat(F.encode(F.lit(domain), "UTF-8"), F.unhex(F.lit("00")), F.encode(payload, "UTF-8")), 256)
