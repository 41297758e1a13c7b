"""Quality, toxicity and pattern scores as Columns (QF, QS, QC, PII, TOX operators)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import count_of, sentences, words

# Patterns and word lists that the scores are defined by.
PII = {
    "email": "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}",
    "phone": "(?:\\+?1[-.]?)?\\(?\\d{3}\\)?[-.]?\\d{3}[-.]?\\d{4}",
    "ssn": "\\d{3}-\\d{2}-\\d{4}",
    "ip": "\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b",
    "credit_card": "\\b\\d{4}[- ]?\\d{4}[- ]?\\d{4}[- ]?\\d{4}\\b",
}
HATE_WORDS = ["hate", "kill", "die", "attack", "fight", "terrorist", "extremist", "radical", "supremacy", "deportation", "genocide"]
HARASSMENT = ["\\bstupid\\b", "\\bidiot\\b", "\\bmoron\\b", "\\bdumb\\b", "\\b(shut up|go away|die)\\b"]
ADULT = ["\\bxxx\\b", "\\bporn\\b", "\\bnsfw\\b", "\\badult\\s+only", "explicit\\s+content", "age\\s+restricted"]
SAFE_WORDS = ["medical", "health", "doctor", "hospital", "patient", "treatment", "diagnosis", "symptom", "medicine", "pharmacy"]
BAD_PATTERNS = ["\\.gitignore", "LICENSE", "copyright", "autogenerated", "do not edit", "ignore Errors", "Mock", "TODO.*implement", "pass # noqa"]
CURATE_TOXIC = ["hack.*hack", "shit", "fuck", "damn", "porn", "nude"]
SPAM = "click here|buy now|limited offer|subscribe now|visit our website"
ATTACKS = ["\\byou\\b.{0,30}(stupid|idiot|dumb|moron|worthless)", "\\byour\\b.{0,30}(fault|problem|choice)"]


# Words and signs of code; patterns of poor prepared texts; keyword densities and suspicious calls of code.
CODE_WORDS = {"python": ["def ", "class ", "import ", "from ", "if __name__"], "javascript": ["function", "const ", "let ", "var ", "import ", "export "], "java": ["public class", "private ", "import java", "System.out"], "go": ["func ", "import ", "package ", "go "]}
CODE_SYMBOLS = ["{", "}", "();", "[];", "//", "/*", "*/", "=>"]
LOW_QUALITY = ["<script[^>]*>.*?</script>", "<style[^>]*>.*?</style>", "google_ad_slot|_ads|advertisement", "click here to|subscribe now|buy now|limited offer"]
DENSITY = {"python": "\\b(def|class|import|from|if|for|while)\\b", "javascript": "\\b(function|const|let|var|import|export|if|for|while)\\b"}
BRANCHES = ["if", "elif", "else", "for", "while", "and", "or", "case", "switch", "catch"]
SUSPICIOUS = ["eval(", "exec(", "os.system(", "subprocess.call(", "shell=true"]
UNSAFE = ["\\b(hack|exploit|bypass)\\s+(security|protection|auth)", "build\\s+(a\\s+)?weapon", "create\\s+(a\\s+)?virus"]
DANGEROUS = ["delete", "drop", "rm -rf", "exec(", "eval(", "system("]
PII_PREP = [
    ("\\b\\d{3}-\\d{2}-\\d{4}\\b", "[SSN]"), ("\\b\\d{9}\\b", "[ID]"), ("\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b", "[EMAIL]"),
    ("\\b(?:\\+?1[-.]?)?\\(?\\d{3}\\)?[-.]?\\d{3}[-.]?\\d{4}\\b", "[PHONE]"), ("\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b", "[IP]"),
]


def score_length(c: Column, least: int = 50, most: int = 1_000_000) -> Column:
    """QF1."""
    n = F.length(c)
    return F.when(n < least, n / least).when(n > most, F.lit(float(most)) / n).otherwise(1.0)


def special_ratio(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[\\p{L}\\p{N}\\s]", "")) / F.length(c)


def score_special(c: Column, most: float = 0.4) -> Column:
    """QF2."""
    r = special_ratio(c)
    return F.when(F.length(c) == 0, 0.0).when(r > most, F.greatest(F.lit(0.0), 1 - r)).otherwise(1.0)


def line_repetition(c: Column) -> Column:
    """QF3, the part on lines: repeated lines over lines, if there are more than ten."""
    lines = F.split(c, "\n", -1)
    return F.when(F.size(lines) > 10, 1 - F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(0.0)


def score_line_lengths(c: Column) -> Column:
    """QF4: too many lines over 500 or under 10 characters cost."""
    lines = F.filter(F.transform(F.split(c, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(lines)
    long = F.size(F.filter(lines, lambda x: F.length(x) > 500)) / n
    short = F.size(F.filter(lines, lambda x: F.length(x) < 10)) / n
    score = 1.0 - F.when(long > 0.3, (long - 0.3) * 2).otherwise(0.0) - F.when(short > 0.5, short - 0.5).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), score))


def comment_ratio(c: Column) -> Column:
    lines = F.filter(F.transform(F.split(c, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: x.rlike("^(#|//|/\\*|\\*|--|%)"))) / F.size(lines))


def score_comments(c: Column) -> Column:
    """QF5."""
    r = comment_ratio(c)
    return F.when(r.isNull(), 0.5).when(r < 0.01, r / 0.01 * 0.5).when(r > 0.8, 1 - r).otherwise(1.0)


def score_repetition(c: Column, lines: Column, grams: Column, most: float = 0.3) -> Column:
    """QF3 from the share of repeated lines and of repeated runs of five characters; texts under 100 characters score 1."""
    r = F.greatest(lines, grams)
    return F.when(F.length(c) < 100, 1.0).when(r > most, F.greatest(F.lit(0.0), 1 - r)).otherwise(1.0)


def weigh(length: Column, special: Column, repetition: Column, lines: Column, comments: Column) -> Column:
    """QF6: the weighted mean of the five scores."""
    return length * 0.15 + special * 0.25 + repetition * 0.30 + lines * 0.10 + comments * 0.20


def vocabulary_richness(c: Column) -> Column:
    """QS1."""
    w = words(c)
    return F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0)


def sentence_variation(c: Column) -> Column:
    """QS3: variation of sentence lengths in words, at most 1; 0.5 for fewer than two sentences."""
    n = F.transform(sentences(c), lambda s: F.size(F.filter(F.split(s, "\\s+"), lambda w: w != "")).cast("double"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        return F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"), (a["n"] + 1).alias("n"))

    def last(a: Column) -> Column:
        mean = a["s"] / a["n"]
        spread = F.sqrt(F.greatest(a["q"] / a["n"] - mean * mean, F.lit(0.0)))
        return F.when(a["n"] < 2, 0.5).when(a["s"] == 0, 0.0).otherwise(F.least(F.lit(1.0), spread / F.nullif(mean, F.lit(0.0))))

    return F.aggregate(n, zero, step, last)


def content_score(c: Column) -> Column:
    """QS7."""
    n_words = F.greatest(F.size(F.filter(F.split(c, "\\s+"), lambda w: w != "")), F.lit(1))
    links = F.regexp_count(c, F.lit("https?://|www\\.")) / n_words
    return F.when(F.length(c) < 50, 0.0).when(c.rlike(f"(?i){SPAM}"), 0.0).when(links > 0.1, 0.3).otherwise(0.7)


def code_score(c: Column) -> Column:
    """QS5."""
    braces = F.abs(count_of(c, "{") - count_of(c, "}")) <= 1
    parts = [(c.contains("import ") | c.contains("from "), 0.15), (c.contains("def ") | c.contains("function ") | c.contains("func "), 0.2), (c.contains("class "), 0.15), (braces, 0.2)]
    return F.least(F.lit(1.0), sum((F.when(p, w).otherwise(0.0) for p, w in parts), F.lit(0.3)))


def issues(c: Column) -> Column:
    """QS9."""
    return F.array_compact(F.array(
        F.when(F.length(c) < 50, "too_short"), F.when((F.upper(c) == c) & (F.lower(c) != c), "all_uppercase"),
        F.when(special_ratio(c) > 0.3, "too_many_symbols"), F.when((F.length(c) - F.length(F.replace(c, F.lit("\n\n\n"), F.lit("")))) / 3 > 3, "excessive_newlines"),
    ))


def pii_counts(c: Column) -> dict[str, Column]:
    """PII1: matches of each pattern."""
    return {k: F.regexp_count(c, F.lit(p)) for k, p in PII.items()}


def redact(c: Column) -> Column:
    """PII2: patterns replaced one after another by their names in brackets."""
    for k, p in PII.items():
        c = F.regexp_replace(c, p, f"[{k.upper()}]")
    return c


def safe_context(low: Column) -> Column:
    """TOX1: a safe word with medical terms within 50 characters around its first place."""
    near = "medical|health|doctor|patient"
    hits = [(F.locate(w, low) > 0) & F.substring(low, F.greatest(F.locate(w, low) - 50, F.lit(1)), F.least(F.locate(w, low) - 1, F.lit(50)) + len(w) + 50).rlike(near) for w in SAFE_WORDS]
    return F.greatest(*(h.cast("int") for h in hits)) == 1


def hate_score(low: Column, safe: Column) -> Column:
    """TOX2."""
    n_words = F.size(F.filter(F.split(low, "\\s+"), lambda w: w != ""))
    kw = sum((low.contains(w).cast("int") for w in HATE_WORDS), F.lit(0)) / F.greatest(n_words / 100, F.lit(1.0))
    har = F.least(F.lit(1.0), sum((low.rlike(p).cast("int") for p in HARASSMENT), F.lit(0)) / 3)
    return (kw + har) / 2 * F.when(safe, 0.5).otherwise(1.0)


def nsfw_score(low: Column, safe: Column) -> Column:
    """TOX3."""
    return sum((low.rlike(p).cast("int") for p in ADULT), F.lit(0)) / 6 * F.when(safe, 0.3).otherwise(1.0)


def attack_score(low: Column) -> Column:
    """TOX4."""
    return F.least(F.lit(1.0), sum((low.rlike(p).cast("int") for p in ATTACKS), F.lit(0)) / 2)


def reject_reason(c: Column) -> Column:
    """TOX8, QC3, QC4: the first ground on which curation rejects a text, or null."""
    return (
        F.when((F.length(c) < 50) | (F.length(c) > 50_000), "length").when(c.rlike("(?i)" + "|".join(BAD_PATTERNS)), "quality").when(F.lower(c).rlike("|".join(CURATE_TOXIC)), "toxicity")
    )


def content_type(c: Column) -> Column:
    """QS4: the first language one of whose words is there, else code by two signs or more, else text."""
    out = None
    for lang, ws in CODE_WORDS.items():
        hit = F.greatest(*(c.contains(w).cast("int") for w in ws)) == 1
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    return out.when(sum((c.contains(x).cast("int") for x in CODE_SYMBOLS), F.lit(0)) >= 2, "code").otherwise("text")


def perplexity_score(loss: Column) -> Column:
    """QS8: 100 over the perplexity of a given loss, at most 1; 0.5 without one."""
    return F.when(loss.isNull(), 0.5).otherwise(F.least(F.lit(1.0), 100.0 / F.exp(loss)))


def prep_quality(c: Column, words_: Column) -> Column:
    """QT1: a fifth off for each poor pattern, times the share of different words."""
    one_line = c.rlike("\\A.{0,20}\\n?\\z|\\A.{10000,}\\n?\\z")
    poor = one_line.cast("int") + sum((c.rlike(f"(?i){p}").cast("int") for p in LOW_QUALITY), F.lit(0)) + F.substring_index(c, "\n", 1).rlike("(?s)(.)\\1{20}").cast("int")
    q = (1.0 - 0.2 * poor) * F.size(F.array_distinct(words_)) / F.greatest(F.size(words_), F.lit(1))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), q))


def complexity(c: Column) -> Column:
    """QC2: one and the number of branching words and question marks."""
    return 1 + F.regexp_count(c, F.lit("\\b(?:" + "|".join(BRANCHES) + ")\\b")) + count_of(c, "?")


def code_verdict(c: Column, lang: Column) -> Column:
    """QC1: the first ground for leaving a code record out, or valid."""
    n = F.size(F.split(c, "\n", -1))
    hits = F.when(lang == "python", F.regexp_count(c, F.lit(DENSITY["python"]))).when(lang == "javascript", F.regexp_count(c, F.lit(DENSITY["javascript"]))).otherwise(F.floor(F.length(c) / 100))
    bad = F.greatest(*(F.lower(c).contains(x).cast("int") for x in SUSPICIOUS)) == 1
    return F.when(n < 5, "too_few_lines").when(n > 50_000, "too_many_lines").when(hits / n < 0.3, "low_quality").when(bad, "suspicious").otherwise("valid")


def pii_score(c: Column) -> Column:
    """PII1: matches of all patterns for every 500 words begun."""
    n = F.size(F.filter(F.split(c, "\\s+"), lambda w: w != ""))
    return sum((F.regexp_count(c, F.lit(p)) for p in PII.values()), F.lit(0)) / F.greatest(n / 500, F.lit(1.0))


def redact_prep(c: Column) -> Column:
    """PII3."""
    for p, to in PII_PREP:
        c = F.regexp_replace(c, p, to)
    return c


def is_safe(c: Column) -> Column:
    """TOX9."""
    return ~c.rlike("(?i)" + "|".join(UNSAFE))


def preference_safety(c: Column) -> Column:
    """TOX10."""
    return F.when(F.greatest(*(F.lower(c).contains(x).cast("int") for x in DANGEROUS)) == 1, 0.0).otherwise(1.0)
