"""Questions in English or French to intents, or to nothing.

A question becomes a row of words. A lexicon marks stretches of them as cues
(an operation, a comparison, "by" ...), columns, known values or numbers, the
longest stretch first. A few readings are tried on the marks; a reading counts
only if every remaining word is one that carries no condition. A question that
isn't understood whole is refused rather than half answered.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import cells
from quern.functions.cells import fold
from quern.operators.intent import Filter, Intent
from quern.operators.profile import per_column, top_values

MOST_LISTED = 30

# The phrases of each language, already folded.
ENGLISH = {
    "mean": "mean, average, avg",
    "median": "median",
    "sum": "sum, total",
    "min": "minimum, min, lowest, smallest",
    "max": "maximum, max, highest, largest, biggest",
    "std": "standard deviation, std, deviation",
    "count": "how many, count, number of",
    "top": "top, best",
    "by": "by, per",
    "correlation": "correlation, correlated, relationship between, link between",
    "distribution": "distribution, breakdown, histogram",
    "shape": "shape, dimensions, how big, size of, rows and columns, columns and rows",
    "missing": "missing, empty cells",
    ">=": "greater than or equal to, at least, >=",
    "<=": "less than or equal to, at most, <=",
    "!=": "is not, not equal to, different from, !=",
    ">": "greater than, more than, above, over, >",
    "<": "less than, under, below, <",
    "=": "equals, equal to, is, =",
}
FRENCH = {
    "mean": "moyenne",
    "median": "mediane",
    "sum": "somme, total",
    "min": "minimum, min, plus petit, plus petite, plus bas, plus basse",
    "max": "maximum, max, plus grand, plus grande, plus eleve, plus elevee",
    "std": "ecart type, ecart-type, deviation",
    "count": "combien, nombre de",
    "top": "top, meilleurs, meilleures",
    "by": "par, selon",
    "correlation": "correlation, correle, lien entre, relation entre",
    "distribution": "distribution, repartition, histogramme, ventilation",
    "shape": "taille du jeu, dimensions, quelle taille, taille du tableau, taille de la table, taille du fichier, taille des donnees, lignes et de colonnes, lignes et colonnes, colonnes et de lignes, colonnes et lignes",
    "missing": "manquante, manquantes, manquants, manquant, vides",
    ">=": "superieur ou egal a, superieure ou egale a, au moins, >=",
    "<=": "inferieur ou egal a, inferieure ou egale a, au plus, <=",
    "!=": "n est pas, different de, differente de, !=",
    ">": "superieur a, superieure a, plus grand que, plus grande que, plus de, >",
    "<": "inferieur a, inferieure a, plus petit que, plus petite que, moins de, <",
    "=": "egal a, egale a, vaut, est, =",
}
# Words that put no condition on rows: parts of a table, what rows stand for, and small words.
TABLE_WORDS = (
    "ligne", "lignes", "rangee", "rangees", "enregistrement", "enregistrements", "entree", "entrees", "observation", "observations", "colonne",
    "colonnes", "champ", "champs", "valeur", "valeurs", "cellule", "cellules", "donnee", "donnees", "jeu", "tableau", "table", "fichier", "taille",
    "total", "row", "rows", "record", "records", "entry", "entries", "column", "columns", "field", "fields", "value", "values", "cell", "cells",
    "data", "dataset", "file", "size", "shape",
)
ROW_WORDS = (
    "personne", "personnes", "gens", "individu", "individus", "passager", "passagers", "client", "clients", "utilisateur", "utilisateurs", "eleve",
    "eleves", "element", "elements", "produit", "produits", "people", "person", "persons", "individual", "individuals", "passenger", "passengers",
    "customer", "customers", "user", "users", "student", "students", "item", "items", "product", "products",
)
SMALL_WORDS_FR = (
    "les", "une", "des", "aux", "dans", "sur", "pour", "avec", "sans", "est", "sont", "etait", "etaient", "cette", "ces", "qui", "que", "quoi",
    "quel", "quelle", "quels", "quelles", "elle", "son", "ses", "leur", "leurs", "notre", "nos", "votre", "vos", "moi", "avait", "avaient", "ont",
    "tous", "toutes", "tout", "toute", "entre", "parmi", "seulement", "aussi", "peut", "donne", "montre", "liste", "affiche",
)
SMALL_WORDS_EN = (
    "the", "for", "with", "without", "are", "was", "were", "been", "what", "which", "who", "whom", "whose", "that", "this", "these", "those", "and",
    "does", "did", "there", "here", "its", "their", "his", "her", "your", "our", "from", "each", "per", "show", "give", "tell", "list", "where",
    "when", "between", "among", "have", "has", "had", "being", "all", "any", "some", "only", "also", "just", "please", "can", "could", "would",
    "should", "will", "much", "many",
)
IGNORED = frozenset(TABLE_WORDS + ROW_WORDS + SMALL_WORDS_FR + SMALL_WORDS_EN)
OPERATIONS = ("mean", "median", "sum", "min", "max", "std")
COMPARISONS = (">=", "<=", "!=", ">", "<", "=")
NUMBER = re.compile(r"-?\d+(?:[.,]\d+)?$")


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    numeric: bool
    values: tuple[str, ...] = ()


def catalogue(df: DataFrame) -> list[ColumnInfo]:
    """What the parser knows of a table: types, and the values of columns with 30 distinct ones at most. Two jobs."""
    figures = {r["column"]: r for r in per_column(df, df.columns, {
        "n": lambda d, c: F.count(cells.text(d, c)), "numbers": lambda d, c: F.count(cells.number(d, c)), "distinct": lambda d, c: F.approx_count_distinct(cells.text(d, c)),
    }).collect()}
    numeric = {c for c, r in figures.items() if r["n"] and r["numbers"] >= 0.95 * r["n"]}
    listed = [c for c, r in figures.items() if c not in numeric and r["distinct"] <= MOST_LISTED]
    values: dict[str, list[str]] = {c: [] for c in listed}
    if listed:
        for r in top_values(df, listed, MOST_LISTED + 5).collect():
            values[r["column"]].append(r["value"])
    return [ColumnInfo(c, c in numeric, tuple(sorted(values.get(c, [])))) for c in df.columns]


@dataclass(frozen=True)
class Mark:
    start: int
    end: int
    kind: str  # cue, column, value, number
    what: object


def words_of(text: str) -> list[str]:
    return [w for w in (w.strip(".,-") or w for w in fold(text).split()) if w.strip(".,-")]


def places(words: list[str], phrase: str) -> Iterable[tuple[int, int]]:
    parts = words_of(phrase)
    n = len(parts)
    return ((i, i + n) for i in range(len(words) - n + 1) if n and words[i : i + n] == parts)


def marks_of(words: list[str], columns: list[ColumnInfo], lexicon: dict[str, str]) -> list[Mark]:
    """All marks; within a kind, those inside a longer one are dropped."""
    found = [Mark(a, b, "cue", cue) for cue, phrases in lexicon.items() for p in phrases.split(", ") for a, b in places(words, p)]
    found += [Mark(a, b, "column", c) for c in columns for a, b in list(places(words, c.name))[:1]]
    found += [Mark(a, b, "value", (c.name, v)) for c in columns for v in c.values if len(fold(v)) >= 2 for a, b in places(words, v)]
    found += [Mark(i, i + 1, "number", float(w.replace(",", "."))) for i, w in enumerate(words) if NUMBER.match(w)]
    whole = [m for m in found if not any(o.kind == m.kind and o.start <= m.start and m.end <= o.end and o.end - o.start > m.end - m.start for o in found)]
    return sorted(whole, key=lambda m: (m.start, m.start - m.end))


class Reading:
    """The marks of one question, with what the readings ask of them."""

    def __init__(self, words: list[str], marks: list[Mark]):
        self.words, self.marks = words, marks
        self.columns = [m for m in marks if m.kind == "column"]

    def cues(self, *names: str) -> list[Mark]:
        return [m for m in self.marks if m.kind == "cue" and m.what in names]

    def by(self, skip: set[str]) -> str | None:
        for cue in self.cues("by"):
            for m in self.columns:
                if m.start >= cue.end and m.what.name not in skip:
                    return m.what.name
        return None

    def condition(self, skip: set[str]) -> Filter | None:
        """A column, a comparison and what follows it; or a known value standing alone."""
        for op in COMPARISONS:
            for cue in self.cues(op):
                before = [m for m in self.columns if m.end <= cue.start]
                if not before:
                    continue
                column = before[-1].what
                for m in self.marks:
                    if m.start < cue.end:
                        continue
                    if column.numeric and m.kind == "number":
                        return Filter(column.name, op, m.what)
                    if not column.numeric and op in ("=", "!=") and m.kind == "value" and m.what[0] == column.name:
                        return Filter(column.name, op, m.what[1])
        for m in self.marks:
            if m.kind == "value" and m.what[0] not in skip:
                return Filter(m.what[0], "=", m.what[1])
        return None

    def hints_at_condition(self) -> bool:
        """An ordering or a number outside column names, which a reading without a filter would drop."""
        inside = {i for m in self.columns for i in range(m.start, m.end)}
        return bool(self.cues(">", ">=", "<", "<=")) or any(re.search(r"\d", w) for i, w in enumerate(self.words) if i not in inside)

    def unread(self, intent: Intent) -> list[str]:
        names = {intent.column, intent.by, intent.other, intent.filter.column if intent.filter else None}
        value = fold(str(intent.filter.value)) if intent.filter else None
        used: set[int] = set()
        for m in self.marks:
            if m.kind == "cue" or m.kind == "column" and m.what.name in names or m.kind == "value" and value is not None and fold(m.what[1]) == value:
                used.update(range(m.start, m.end))
        return [w for i, w in enumerate(self.words) if i not in used and len(w) >= 3 and not NUMBER.match(w) and w not in IGNORED]


def parse_question(question: str, columns: list[ColumnInfo], lang: str = "en") -> Intent | None:
    """The intent of a question, or None where it isn't understood whole."""
    words = words_of(question)
    if not words:
        return None
    r = Reading(words, marks_of(words, columns, FRENCH if lang.startswith("fr") else ENGLISH))
    intent = read(r)
    return intent if intent and not r.unread(intent) else None


def read(r: Reading) -> Intent | None:
    names = [m.what for m in r.columns]
    numeric = [c for c in names if c.numeric]
    if r.cues("missing"):
        return Intent("missing")
    if r.cues("correlation") and len(names) >= 2:
        return Intent("correlation", names[0].name, other=names[1].name)
    if r.cues("distribution") and names:
        return Intent("distribution", names[0].name)
    if r.cues("shape"):
        return Intent("shape")
    operations = [m.what for m in r.cues(*OPERATIONS)]
    tops = r.cues("top")
    if tops and names:
        return read_top(r, tops[0], operations)
    if operations and numeric:
        column = numeric[0].name
        group = r.by({column})
        condition = r.condition({column, group or column})
        if condition is None and r.hints_at_condition():
            return None
        return Intent("aggregate", column, operations[0], group, filter=condition)
    if r.cues("count"):
        group = r.by(set())
        condition = r.condition({group} if group else set())
        if group:
            return Intent("top", by=group, k=12, filter=condition)
        return None if condition is None and r.hints_at_condition() else Intent("count", filter=condition)
    return None


def read_top(r: Reading, cue: Mark, operations: list[str]) -> Intent:
    after = [m.what for m in r.columns if m.start >= cue.start and not m.what.numeric]
    words = [m.what for m in r.columns if not m.what.numeric]
    group = (after or words or [r.columns[0].what])[0].name
    k = next((int(m.what) for m in r.marks if m.kind == "number" and m.start == cue.end), 5)
    measure = next((m.what.name for m in r.columns if m.what.numeric and m.what.name != group), None)
    ranked = operations[0] if operations and measure else None
    return Intent("top", measure if ranked else None, ranked, group, k=k, filter=r.condition({group}))


def ask(df: DataFrame, question: str, lang: str = "en", rescue=None) -> DataFrame | None:
    """Parse and run; ``rescue(question, columns)`` may offer an intent where the parser refuses."""
    from quern.operators.intent import compile_intent

    columns = catalogue(df)
    intent = parse_question(question, columns, lang) or (rescue(question, columns) if rescue else None)
    return compile_intent(df, intent) if intent else None
