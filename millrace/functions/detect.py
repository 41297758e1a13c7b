"""Language of a file or text by extension, first line, signatures and letters (LD1 to LD5, LD7 to LD10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension.
EXTENSIONS = {
    "python": ".py .pyw .pyx", "javascript": ".js .jsx .mjs", "typescript": ".ts .tsx", "java": ".java", "kotlin": ".kt", "scala": ".scala", "c": ".c .h",
    "cpp": ".cpp .hpp .cc .cxx", "csharp": ".cs", "vb": ".vb", "go": ".go", "rust": ".rs", "ruby": ".rb", "php": ".php .phtml", "swift": ".swift", "sql": ".sql",
    "html": ".html .htm .xhtml", "css": ".css", "scss": ".scss", "less": ".less", "bash": ".sh .bash .zsh", "perl": ".pl .pm", "lua": ".lua", "r": ".r", "matlab": ".m",
    "julia": ".jl", "dart": ".dart", "lisp": ".lisp", "clojure": ".clj .cljs", "erlang": ".erl", "elixir": ".ex .exs", "haskell": ".hs", "ocaml": ".ml", "vue": ".vue",
    "yaml": ".yaml .yml", "json": ".json", "xml": ".xml .svg", "markdown": ".md .mdx", "latex": ".tex", "dockerfile": ".dockerfile", "terraform": ".tf",
}
# Interpreters of a first line, in order of precedence.
SHEBANGS = [("python", "python"), ("node", "javascript"), ("ruby", "ruby"), ("perl", "perl"), ("bash", "bash"), ("sh", "bash"), ("zsh", "bash"), ("java", "java"), ("lua", "lua"), ("racket", "racket")]
# Signatures of programming languages; a language's score is the share of its patterns that are found.
SIGNATURES = {
    "python": [r"import\s+\w+", r"from\s+\w+\s+import", r"def\s+\w+\s*\(", r"class\s+\w+\s*:", r"if __name__"],
    "javascript": [r"function\s+\w+\s*\(", r"const\s+\w+\s*=", r"let\s+\w+\s*=", r"var\s+\w+\s*=", r"=>", r"console\.log", r"document\.", r"window\.", r"addEventListener", r"\$\("],
    "typescript": [r"interface\s+\w+", r"type\s+\w+\s*=", r":\s*(string|number|boolean)\b"],
    "java": [r"public\s+(class|static|void)", r"private\s+\w+", r"import\s+java\."],
    "cpp": [r'#include\s*[<"]', r"using namespace", r"std::", r"int main\s*\("],
    "go": [r"func\s+\w+", r"package\s+\w+", r"import\s+\("],
    "rust": [r"fn\s+\w+", r"let\s+mut", r"impl\s+\w+"],
}
# Texts whose letters are the signature of a natural language.
LETTERS = {"en": "theandthatyouforarenotwithhavewillthisfromtheybeenmore", "zh": "的了不是人有在中国年大和会主为生发工时", "ja": "のたにあをがでといつものかられんし", "de": "der die und den das mit auf für ist nicht", "fr": "les des dans pour une sur pas avec comme", "es": "que los las del para por con una como más"}
# Words and letters by which natural languages are counted.
PATTERNS = {
    "en": r"\b(the|is|are|was|were|have|has|be|been|being|that|which|with|from|they|this|for|but|not|you|all|can|had|her|were|she|there|their|what|so|up|out|if|about|who|get|which|go|me)\b",
    "es": r"\b(el|la|los|las|un|una|de|en|que|es|por|para|con|una|su|al|se|le|lo|mas|ya|o|este|esta|pero|sus|como|mas|muy|todo)\b",
    "fr": r"\b(le|la|les|un|une|des|de|du|en|que|qui|est|pas|sur|une|pour|avec|plus|ce|mais|comme|tout|ont|dans|ces|ses|faire|vous)\b",
    "de": r"\b(der|die|das|und|in|zu|den|das|nicht|mit|sie|es|von|sie|auch|auf|ein|eine|als|aus|nur|uber|habe|hat|werden|worden)\b",
    "pt": r"\b(o|a|os|as|um|uma|de|em|que|e|para|com|nao|por|mais|como|seu|sua|seus|suas|dos|das|ao|aos|no|na)\b",
    "it": r"\b(il|la|di|che|e|in|un|una|per|non|sono|con|da|io|lei|gli|le|si|questo|questa|quello|quella|anche|pero)\b",
    "zh": r"[\x{4e00}-\x{9fff}]", "ja": r"[\x{3040}-\x{309f}\x{30a0}-\x{30ff}]", "ko": r"[\x{ac00}-\x{d7af}]", "ar": r"[\x{0600}-\x{06ff}]", "ru": r"[\x{0400}-\x{04ff}]",
}
# Languages of code records by extension, then by the first of these patterns that a line begins with or holds.
CODE_EXTENSIONS = {
    "python": ".py .pyw .ipynb", "javascript": ".js .mjs .cjs", "typescript": ".ts .tsx", "java": ".java", "cpp": ".cpp .cc .cxx .hpp .h", "c": ".c", "csharp": ".cs", "go": ".go", "rust": ".rs",
    "ruby": ".rb", "php": ".php", "swift": ".swift", "kotlin": ".kt .kts", "scala": ".scala", "julia": ".jl", "r": ".r", "sql": ".sql", "bash": ".sh .bash", "powershell": ".ps1", "html": ".html .htm",
    "css": ".css .scss .sass .less", "json": ".json", "yaml": ".yaml .yml", "xml": ".xml", "markdown": ".md .markdown",
}
CODE_PATTERNS = {
    "python": [r"^import\s+\w+", r"^from\s+\w+\s+import", r"def\s+\w+\s*\(", r"class\s+\w+\s*[:\(]"],
    "javascript": [r"^const\s+\w+\s*=", r"^let\s+\w+\s*=", r"^function\s+\w+\s*\(", r"export\s+"],
    "typescript": [r":\s*(string|number|boolean|any)\s*[;=]", r"interface\s+\w+\s*\{", r"type\s+\w+\s*="],
    "java": [r"^public\s+class\s+", r"^import\s+java\.", r"System\.out\.print"],
    "cpp": [r"#include\s*<", r"^std::", r"cout\s*<<", r"int\s+main\s*\("],
    "go": [r"^package\s+\w+", r"^import\s+\(", r"func\s+\w+\s*\(", r"\.go$"],
    "rust": [r"^fn\s+\w+", r"^let\s+mut\s+", r"impl\s+\w+", r"use\s+std::"],
}
# Extensions that curation knows.
CURATED = {"python": ".py", "javascript": ".js .jsx", "typescript": ".ts .tsx", "rust": ".rs", "go": ".go", "java": ".java", "c": ".c .h", "cpp": ".cpp .hpp", "csharp": ".cs", "ruby": ".rb", "php": ".php", "swift": ".swift", "kotlin": ".kt", "scala": ".scala", "sql": ".sql", "bash": ".sh .bash .zsh"}


def extension(path: Column) -> Column:
    """The last suffix of a path, in lower case with its dot; empty if there is none."""
    return F.regexp_extract(F.lower(path), r"[^/](\.[^./]+)$", 1)


def by_extension(path: Column, known: dict[str, str] = EXTENSIONS) -> Column:
    """LD1: a lookup in a literal map, so no join."""
    pairs = [F.lit(x) for lang, exts in known.items() for e in exts.split() for x in (e, lang)]
    return F.create_map(*pairs)[extension(path)]


def by_shebang(c: Column) -> Column:
    """LD2: by the first line."""
    first = F.substring_index(c, "\n", 1)
    out = F.when(first.rlike(f"^#!.*{SHEBANGS[0][0]}"), SHEBANGS[0][1])
    for p, lang in SHEBANGS[1:]:
        out = out.when(first.rlike(f"^#!.*{p}"), lang)
    return out


def _best(scores: list[tuple[str, Column]]) -> Column:
    """struct s, o, l of the highest score; the first of equals."""
    return F.array_max(F.array(*(F.struct(s.cast("double").alias("s"), F.lit(-i).alias("o"), F.lit(lang).alias("l")) for i, (lang, s) in enumerate(scores))))


def by_content(c: Column) -> Column:
    """LD3: struct s, o, l of the language with the highest share of its signatures; ``cascade`` holds it against the least."""
    return _best([(lang, sum((c.rlike(p).cast("int") for p in ps), F.lit(0)) / len(ps)) for lang, ps in SIGNATURES.items()])


def by_letters(head: Column) -> Column:
    """LD4: struct s, o, l of the language with the highest share of its letters in ``head``, the bound first 500 characters in lower case."""
    return _best([(lang, sum((head.contains(x).cast("int") for x in sorted(set(sig))), F.lit(0)) / len(set(sig))) for lang, sig in LETTERS.items()])


def cascade(path: Column, c: Column, content: Column, letters: Column) -> Column:
    """LD5: struct language, confidence, method, is_code of the first step that tells; ``content`` and ``letters`` are the
    results of ``by_content`` and ``by_letters``, bound so that they aren't worked out for each mention."""

    def found(lang: Column, confidence: Column, method: str, code: bool) -> Column:
        return F.when(lang.isNotNull(), F.struct(lang.alias("language"), confidence.cast("double").alias("confidence"), F.lit(method).alias("method"), F.lit(code).alias("is_code")))

    signed = F.when((F.length(c) >= 50) & (content["s"] >= 0.3), content["l"])
    spoken = F.when(F.length(c) >= 100, F.when(letters["s"] >= 0.2, letters["l"]).otherwise("unknown"))
    return F.coalesce(
        found(by_extension(path), F.lit(0.95), "extension", True), found(by_shebang(c), F.lit(0.9), "shebang", True),
        found(signed, content["s"], "content", True), found(spoken, letters["s"], "ngram", False), found(F.lit("unknown"), F.lit(0.0), "none", False),
    )


def by_pattern(c: Column, least: int = 5) -> Column:
    """LD7: the language with the most matches, if more than ``least``; else unknown."""
    low = F.lower(c)
    best = _best([(lang, F.regexp_count(low, F.lit(p))) for lang, p in PATTERNS.items()])
    return F.when(best["s"] > least, best["l"]).otherwise("unknown")


def of_code(path: Column, c: Column) -> Column:
    """LD8: by extension, else by the first language with a pattern in the text; null if none."""
    hits = [F.when(c.rlike("(?m)" + "|".join(f"(?:{p})" for p in ps)), lang) for lang, ps in CODE_PATTERNS.items()]
    return F.coalesce(by_extension(path, CODE_EXTENSIONS), *hits)


def curated(path: Column, c: Column) -> Column:
    """LD9: by extension, else by marks beside an import; else unknown."""
    has = c.contains
    guess = F.when(~c.rlike(r"(?m)^import\s+\w+"), None).when(has("from typing import"), "python").when(has("console.log") | has("document."), "javascript").when(has("func ") & has("package "), "go").when(has("fn ") & has("let "), "rust")
    return F.coalesce(by_extension(path, CURATED), guess, F.lit("unknown"))


def bucket(lang: Column) -> Column:
    """LD10: the languages that mixtures tell apart."""
    return F.when(lang.isin("python", "javascript", "rust"), lang).otherwise("other")
