"""Native text rules: fear lexicon, grammar rule table, vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FEAR_LABEL = "Fear_Mongering"
NO_FEAR_LABEL = "Not_Fear_Mongering"

# Default wording of the lexicon scorer; callers may pass their own.
FEAR_WORDS = (
    "alarming", "apocalypse", "attack", "catastrophe", "collapse", "crisis", "danger",
    "dangerous", "deadly", "death", "destroy", "disaster", "doom", "emergency", "fear",
    "horrifying", "kill", "nightmare", "outbreak", "panic", "scary", "shocking", "terrifying",
    "threat", "toxic", "warning",
)


def lexicon_hits(text: Column, words=FEAR_WORDS) -> Column:
    """How often whole words of the lexicon occur, in any case."""
    pattern = r"(?<!\p{L})(?:" + "|".join(words) + r")(?!\p{L})"
    return F.regexp_count(F.lower(text), F.lit(pattern))


def fear_prediction(text: Column, words=FEAR_WORDS) -> Column:
    """Struct of label and confidence: hits / (hits + 1) for text with hits, else 1."""
    hits = lexicon_hits(text, words)
    return F.struct(
        F.when(hits > 0, FEAR_LABEL).otherwise(NO_FEAR_LABEL).alias("label"),
        F.when(hits > 0, hits / (hits + 1)).otherwise(F.lit(1.0)).alias("score"),
    )


# Grammar rules counted by pattern, one error per match.
GRAMMAR_PATTERNS = (
    r"^[a-z]",  # a sentence starts with a capital letter
    r"[!?,;:]{2,}",  # repeated punctuation
    r" [.,;:!?]",  # space before punctuation
    r"[,;][A-Za-z]",  # no space after a comma or semicolon
    r"(?:^| )[Aa] [aeiou]",  # "a" before a vowel
    r"(?:^| )[Aa]n [bcdfgjklmnpqrstvwxz]",  # "an" before a consonant
)
# A word followed by itself, counted once per repetition.
DOUBLED_WORD = r"(?<![^ ])(\p{L}++) (?=\1(?: |$))"
BRACKETS = (("(", ")"), ("[", "]"), ("{", "}"))


def _grammar_errors(sentence: str) -> str:
    """SQL for the errors in one sentence by the fixed rule table."""

    def occurrences(char: str) -> str:
        return f"(length({sentence}) - length(replace({sentence}, '{char}', '')))"

    rules = [f"regexp_count({sentence}, r'{pattern}')" for pattern in GRAMMAR_PATTERNS]
    rules += [f"int({occurrences(a)} <> {occurrences(b)})" for a, b in BRACKETS]
    rules.append(f"{occurrences(chr(34))} % 2")
    rules.append(f"regexp_count(lower({sentence}), r'{DOUBLED_WORD}')")
    return " + ".join(rules)


def grammar_error_rate(sentences: str) -> Column:
    """Errors per sentence of a column of sentence arrays, 0.0 without sentences."""
    total = f"aggregate({sentences}, 0, (total, s) -> total + {_grammar_errors('s')})"
    return F.expr(f"if(size({sentences}) > 0, {total} / size({sentences}), 0.0D)")


def _dot(a: str, b: str) -> str:
    products = f"zip_with({a}, {b}, (x, y) -> double(x) * double(y))"
    return f"aggregate({products}, 0.0D, (total, x) -> total + x)"


def cosine01(a: str, b: str) -> Column:
    """Cosine of two vector columns mapped from [-1, 1] to [0, 1]; NULL where one is zero."""
    norms = f"sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})"
    return F.expr(f"(try_divide({_dot(a, b)}, {norms}) + 1) / 2")
