"""Quality rules, line first (native).

Every line is judged on its own by punctuation, navigation, boilerplate, shouting
and repetition rules, and runs of short lines without a mark at their end are taken
for lists of links; lines that fail are removed, and a document that loses too
much of its text, or that fails one of the two document rules, is rejected.

Defined results for odd input: a null or empty text has no words, so it fails the
minimum word count; a null id is passed through; repeated rows are judged one by
one; an empty table gives an empty table; only the id and text columns are read,
so other columns may have any name.  A very long text is one row of work: all
steps are linear or n log n in its length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, space_words, total

SYMBOL_CLASS = "[#*$%&|<>]"

#: Phrases that mark a line as boilerplate (compared in lower case), in the four languages of the tables.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "licensed under",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "terms of service",
    "terms of use",
    "use of cookies",
    "tous droits réservés",
    "politique de confidentialité",
    "mentions légales",
    "conditions d'utilisation",
    "utilisation de cookies",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "verwendung von cookies",
    "todos los derechos reservados",
    "política de privacidad",
    "términos de uso",
    "aviso legal",
    "uso de cookies",
)
#: Parts of the phrases, fewer than they are, of which each has one: a text without any of them has no phrase.
_PHRASE_PARTS = (
    "cookie", "policy", "reserv", "réserv", "terms of", "términos", "legal", "légal", "javascript", "licensed", "lorem", "newsletter",
    "confidential", "utilisation", "vorbehalten", "datenschutz", "nutzungs", "privacidad",
)
assert all(any(part in phrase for part in _PHRASE_PARTS) for phrase in BOILERPLATE)

#: Words of menus, in the same languages. A short line of nothing else is navigation.
MENU_WORDS = frozenset(
    "home about contact login logout register search menu news next previous prev back top page pages sitemap help faq share skip more"
    " accueil connexion inscription rechercher recherche suivant suivante précédent précédente retour plan aide actualités"
    " startseite kontakt anmelden registrieren suche suchen weiter zurück seite impressum hilfe nachrichten über uns"
    " inicio contacto acceder registrarse buscar siguiente anterior volver página ayuda noticias mapa".split()
)
NAV_MARKS = "|·•»›→/>"
_NAV_SEPARATOR = r"[|·•»›→]|\s[/>]\s"
_MENU_LINE = r"(?iu)^[^\p{L}]*(?:(?:" + "|".join(sorted(MENU_WORDS)) + r")(?:[^\p{L}]+|$))+$"
_TERMINAL = r"[.!?…:;,][\p{Pe}\p{Pf}\p{Pi}\"'\s]*$"


@dataclass(frozen=True)
class QualityLimits:
    """Thresholds in whole percent, so that comparisons stay in integers."""

    min_words: int = 10
    max_repeat_pct: int = 20
    window: int = 5
    max_line_symbol_pct: int = 30
    max_line_shout_pct: int = 30
    min_line_distinct_pct: int = 20
    distinct_from_words: int = 10
    min_kept_pct: int = 50
    max_line_punctuation_pct: int = 40
    nav_items: int = 3
    nav_item_words: int = 3
    menu_line_words: int = 8
    short_run_lines: int = 4


def _repeat_words(words: Column, k: int) -> Column:
    """Words inside ``k``-word windows that occur at least twice in ``words``."""

    def covered(grams: Column) -> Column:
        located = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def positions(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, j: x["h"].eqNullSafe(F.get(s, j - 1)["h"])
                | x["h"].eqNullSafe(F.get(s, j + 1)["h"]),
            )
            return F.sort_array(F.transform(twice, lambda x: x["p"]))

        def length(p: Column) -> Column:
            return total(
                F.transform(p, lambda x, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - x, F.lit(k))))
            )

        return let(located, lambda s: let(positions(s), length))

    def grams(h: Column) -> Column:
        """Hashes of all windows, by doubling: a window is two shorter ones, which overlap where they must."""

        def wider(g: Column, width: int) -> Column:
            if width == k:
                return F.slice(g, F.lit(1), F.size(h) - (k - 1))
            step = min(width, k - width)
            pairs = lambda x: F.zip_with(x, F.slice(x, F.lit(step + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))
            return let(pairs(g), lambda x: wider(x, width + step))

        return wider(h, 1)

    counted = let(
        let(F.transform(words, lambda x: F.xxhash64(x)), grams),
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)),
    )
    return F.when(F.size(words) >= k, counted).otherwise(F.lit(0).cast("long"))


def _holds(text: Column, parts) -> Column:
    """Whether a text holds any of some parts; searches of bytes, where a pattern would step through all characters."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def _boiler(low: Column) -> Column:
    return _holds(low, BOILERPLATE)


def _no_space(text: Column) -> Column:
    for c in " \n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _line_passes(x: Column, has: Column, limits: QualityLimits) -> Column:
    """True for a line ``struct<line, w>`` that no line rule removes; a line without words always stays.

    ``has`` says whether the text holds symbols, shouting, boilerplate or separators of menus
    anywhere; no line can fail a rule whose marks its text has nowhere.
    """
    line, w = x["line"], x["w"]
    n = F.size(w)

    def items(parts: Column) -> Column:
        """Several separated items, none of them long."""
        full = F.filter(parts, lambda y: y.rlike(r"[\p{L}\p{N}]"))
        return let(full, lambda y: (F.size(y) >= limits.nav_items) & F.forall(y, lambda z: F.size(space_words(z)) <= limits.nav_item_words))

    bad = (
        (F.length(F.regexp_replace(line, r"[a-zA-Z0-9 ]+|[\p{L}\p{N}\s]+", "")) * 100 > F.length(line) * limits.max_line_punctuation_pct)
        | (has["symbols"] & (F.size(F.filter(w, lambda y: y.rlike(SYMBOL_CLASS))) * 100 > n * limits.max_line_symbol_pct))
        | (has["shouts"] & (F.size(F.filter(w, lambda y: y.endswith("!!"))) * 100 > n * limits.max_line_shout_pct))
        | ((n >= limits.distinct_from_words) & (F.size(F.array_distinct(w)) * 100 <= n * limits.min_line_distinct_pct))
        | (has["boiler"] & let(F.lower(line), _boiler))
        | (has["bars"] & let(F.split(line, _NAV_SEPARATOR), items))
        | ((n <= limits.menu_line_words) & line.rlike(_MENU_LINE))
    )
    return (n == 0) | ~bad


def _in_runs(lines: Column, limits: QualityLimits) -> Column:
    """Places of the lines in runs of short ones; blank lines neither end a run nor count."""

    def marked(full: Column) -> Column:
        # The places of the lines that end runs, with the two ends of the text.
        stops = F.concat(F.array(F.lit(-1)), F.filter(F.transform(full, lambda x, i: F.when(~x["short"], i)), lambda i: i.isNotNull()), F.array(F.size(full)))
        runs = lambda s: F.filter(F.transform(s, lambda x, j: F.struct((x + 1).alias("a"), F.get(s, j + 1).alias("b"))), lambda r: r["b"] - r["a"] >= limits.short_run_lines)
        places = lambda r: F.flatten(F.transform(r, lambda y: F.transform(F.slice(full, y["a"] + 1, y["b"] - y["a"]), lambda z: z["i"])))
        return let(stops, lambda s: let(runs(s), places))

    full = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x["short"].alias("short"), F.size(x["w"]).alias("n"))), lambda x: x["n"] > 0)
    enough = F.size(F.filter(lines, lambda x: x["short"])) >= limits.short_run_lines
    return F.when(enough, let(full, marked)).otherwise(F.array().cast("array<int>"))


def _measured(text: Column, limits: QualityLimits) -> Column:
    """One struct with every measure of a text and its text without failing lines.

    It is bound by ``let`` throughout: were it a plain struct, each of its fields
    would be computed apart, and the words split anew for each.  Words never hold a
    line end, so those of a text are those of its lines.
    """

    def of_line(line: Column) -> Column:
        # A line of few words that no mark ends, as an item of a list of links is.
        few = lambda w: (F.size(w) > 0) & (F.size(w) <= limits.nav_item_words) & ~line.rlike(_TERMINAL) & line.rlike(r"\p{L}")
        return let(space_words(line), lambda w: F.struct(line.alias("line"), w.alias("w"), few(w).alias("short")))

    def of_text(t: Column) -> Column:
        return let(F.transform(F.split(t, "\n"), of_line), lambda lines: let(F.flatten(F.transform(lines, lambda x: x["w"])), lambda w: of_words(t, lines, w)))

    def of_words(t: Column, lines: Column, w: Column) -> Column:
        symbols = F.when(_holds(t, SYMBOL_CLASS[1:-1]), F.size(F.regexp_extract_all(t, F.lit(SYMBOL_CLASS), F.lit(0)))).otherwise(0)
        has = F.struct(
            symbols.cast("long").alias("n_symbols"), F.contains(t, F.lit("!!")).alias("shouts"), let(F.lower(t), lambda low: _holds(low, _PHRASE_PARTS)).alias("boiler"), _holds(t, NAV_MARKS).alias("bars"),
        )
        flags = lambda h: F.struct((h["n_symbols"] > 0).alias("symbols"), h["shouts"].alias("shouts"), h["boiler"].alias("boiler"), h["bars"].alias("bars"))
        return let(has, lambda h: let(flags(h), lambda f: let(kept_lines(lines, f), lambda kept: result(t, lines, w, h, kept))))

    def kept_lines(lines: Column, f: Column) -> Column:
        def without(gone: Column) -> Column:
            rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
            return F.when(F.size(gone) == 0, lines).otherwise(rest)

        return F.filter(let(_in_runs(lines, limits), without), lambda x: _line_passes(x, f, limits))

    def result(t: Column, lines: Column, w: Column, has: Column, kept: Column) -> Column:
        full = F.transform(F.filter(lines, lambda x: F.size(x["w"]) > 0), lambda x: x["line"])
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(_no_space(t)).cast("long").alias("word_chars"),
            has["n_symbols"].alias("n_symbols"),
            let(full, lambda y: F.size(y) - F.size(F.array_distinct(y))).cast("long").alias("n_dup_lines"),
            _repeat_words(w, limits.window).alias("n_repeat_words"),
            F.when(F.size(kept) == F.size(lines), t).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).alias("cleaned"),
            total(F.transform(kept, lambda x: F.size(x["w"]).cast("long"))).alias("n_kept"),
        )

    return let(F.coalesce(text, F.lit("")), of_text)


def _judged(docs: DataFrame, keep: list[Column], text: str, limits: QualityLimits) -> DataFrame:
    # Exploded from an array of one: a filter on its fields is not pushed below, where it would compute all measures once more.
    rows = docs.select(*keep, F.explode(F.array(_measured(docs[text], limits))).alias("m"))
    m = F.col("m")
    failed = (m["n_words"] < limits.min_words) | (100 * m["n_repeat_words"] > limits.max_repeat_pct * m["n_words"])
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(
        *[c for c in rows.columns if c != "m"],
        *[m[c].alias(c) for c in measures],
        failed.alias("base_failed"),
        (~failed & (m["n_kept"] * 100 >= m["n_words"] * limits.min_kept_pct)).alias("kept"),
        m["cleaned"].alias("cleaned_text"),
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: QualityLimits = QualityLimits()
) -> DataFrame:
    """Measures, verdict and text without failing lines, one row per input row."""
    return _judged(docs, [docs[id_col].alias("doc_id")], text_col, limits)


def clean_documents(docs: DataFrame, text_col: str = "text", limits: QualityLimits = QualityLimits()) -> DataFrame:
    """The documents that are kept, with failing lines taken out of their text.

    All input columns come back in their order; ``n_chars`` follows the new text
    where the input has it.
    """
    whole = F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("row")
    judged = _judged(docs, [whole], text_col, limits).filter("kept")
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("cleaned_text").alias(c))
        elif c == "n_chars":
            out.append(F.length("cleaned_text").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("row").getField(c).alias(c))
    return judged.select(*out)
