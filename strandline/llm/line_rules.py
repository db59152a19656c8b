"""Quality rules, line first: lines that fail a rule go, and a document that loses too much text is rejected.

Everything here is a Spark column expression: no Python runs on the executors and nothing is shuffled, so a hot source
or a group of copies costs no more than any other rows.

Defined results. A null or empty text has no words, no lines and empty cleaned text; its counts are 0 and, having under
10 words, it fails the base rule. Very long texts are read whole. Rows are judged one by one: repeated rows get the same
verdict, an empty table gives an empty result, and columns of the input other than the text play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACE, free_name

#: Phrases of page furniture by language, lower case.
BOILERPLATE = {
    "en": (
        "all rights reserved", "cookie policy", "enable javascript", "privacy policy", "terms of service", "terms of use",
        "click here", "read more", "sign in", "log in", "subscribe to", "share this", "skip to content", "lorem ipsum",
    ),
    "de": (
        "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "allgemeine geschäftsbedingungen", "cookies akzeptieren",
        "javascript aktivieren", "hier klicken", "weiterlesen", "mehr erfahren", "jetzt anmelden", "newsletter abonnieren", "zum inhalt springen",
    ),
    "fr": (
        "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions générales", "accepter les cookies",
        "activer javascript", "cliquez ici", "lire la suite", "en savoir plus", "se connecter", "abonnez-vous", "aller au contenu",
    ),
    "es": (
        "todos los derechos reservados", "política de privacidad", "aviso legal", "términos de uso", "aceptar cookies",
        "activar javascript", "haga clic aquí", "leer más", "saber más", "iniciar sesión", "suscríbete a", "saltar al contenido",
    ),
}
#: A phrase between characters that are neither letters nor digits, in a lower-cased line.
PHRASE = r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(p for phrases in BOILERPLATE.values() for p in phrases) + r")(?:$|[^\p{L}\p{N}])"
#: A line that ends a sentence: a final mark, with closing quotes and brackets after it.
ENDED = r"[.!?…。！？।۔؟:;][\"'”’»›)\]\x20\x09-\x0D]*$"
TEASER = r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """Thresholds. Shares are in hundredths so that all comparisons are of whole numbers."""

    symbol_share: int = 10  # of a line's characters outside white space
    upper_share: int = 70  # of a line's letters, in lines of at least upper_words words
    upper_words: int = 4
    menu_share: int = 25  # of a line's words that are bare separators, if there are at least menu_words of them
    menu_words: int = 3
    boilerplate_words: int = 12  # boilerplate phrases condemn lines of at most so many words
    open_words: int = 5  # lines under so many words must end a sentence
    teaser_words: int = 25  # lines of at most so many words must not trail off in dots
    lost_share: int = 50  # a document losing more of its word characters than this is rejected


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def line_fails(line: Column, rules: LineRules) -> Column:
    """True for a line that breaks a rule; lines without words never do."""
    return let(F.struct(line.alias("line"), F.regexp_replace(line, SPACE, "").alias("dense"), words_of(line).alias("words")), lambda x: _fails(x, rules))


def _fails(x: Column, rules: LineRules) -> Column:
    """Symbols, capitals, menus, boilerplate, fragments without an end, teasers."""
    line, dense, words = x["line"], x["dense"], x["words"]
    n = F.length(dense)
    letters = F.length(F.regexp_replace(dense, r"[^\p{L}]+", ""))
    upper = F.regexp_count(dense, F.lit(r"\p{Lu}"))
    symbols = n - F.length(F.translate(dense, SYMBOLS, ""))
    menu = F.size(F.filter(words, lambda w: w.isin("|", "»", "›", ">", "•", "·", "/")))
    size = F.size(words)
    return (size > 0) & (
        (100 * symbols > rules.symbol_share * n)
        | ((size >= rules.upper_words) & (upper > 0) & (100 * upper > rules.upper_share * letters))
        | ((menu >= rules.menu_words) & (100 * menu > rules.menu_share * size))
        | ((size <= rules.boilerplate_words) & F.lower(line).rlike(PHRASE))
        | ((size < rules.open_words) & ~line.rlike(ENDED))
        | ((size <= rules.teaser_words) & line.rlike(TEASER))
    )


def let(value: Column, body) -> Column:
    """body of value, with value computed once: a plain reference inside a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def repeat_words(words: Column, window: int = 5) -> Column:
    """How many words lie in a window of five words that occurs at least twice in the text.

    Each window is hashed to a long of 64 bits; only texts in which a hash occurs twice go on to the scan."""

    def keys(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - window),
            lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(window)]),
        )

    def count(found: Column) -> Column:
        none = F.lit(0).cast("long")
        return F.when(F.size(F.array_distinct(found)) == F.size(found), none).otherwise(_covered(found, window))

    several = F.size(words) > window
    return F.when(several, let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(keys(h), count))).otherwise(0)


def _covered(keys: Column, window: int) -> Column:
    """Words covered by windows whose key occurs twice: one sort by key and position brings equal windows together, at any
    number of windows."""

    def positions(placed: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            return F.coalesce(F.get(placed, j)["k"] == x["k"], F.lit(False))

        found = F.filter(placed, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def spans(found: Column) -> Column:
        return F.transform(found, lambda p, i: F.least(F.coalesce(F.get(found, i + 1) - p, F.lit(window)), F.lit(window)))

    total = lambda found: F.aggregate(spans(found), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    return let(placed, lambda p: let(positions(p), total))


def clean_lines(df: DataFrame, text: str = "text", rules: LineRules = LineRules(), *, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns named in keep, with the counts of each text, its cleaned text and the verdict."""
    t = F.coalesce(F.col(text), F.lit(""))
    whole, words, lines, left = (free_name(df, n) for n in ("_text", "_words", "_lines", "_left"))
    base = df.select(*keep, t.alias(whole), words_of(t).alias(words), F.split(t, "\n").alias(lines))
    base = base.withColumn(lines, F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    base = base.withColumn(left, F.filter(lines, lambda x: ~line_fails(x, rules)))
    out = base.select(
        *keep,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col(words)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(left).cast("long").alias("n_lines_kept"),
        F.length(F.regexp_replace(F.array_join(left, ""), SPACE, "")).cast("long").alias("clean_chars"),
        F.array_join(left, "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    lost = 100 * (F.col("word_chars") - F.col("clean_chars")) > rules.lost_share * F.col("word_chars")
    return out.withColumns({"base_failed": failed, "kept": ~failed & ~lost})
