"""Quality rules: text statistics in SQL functions, and a decision list learned from labelled statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let, staged

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that rules may test, as SQL over the base statistics and the text; in per mille, so exact integers.
RATIOS = {
    "symbol_rate": "1000 * n_symbols div greatest(word_chars, 1)",
    "bang_rate": "1000 * n_bangs div greatest(word_chars, 1)",
    "pipe_rate": "1000 * n_pipes div greatest(n_words, 1)",
    "upper_rate": "1000 * n_upper div greatest(word_chars, 1)",
    "digit_rate": "1000 * n_digits div greatest(word_chars, 1)",
    "repeat_rate": "1000 * n_repeat_words div greatest(n_words, 1)",
    "dup_line_rate": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "word_length": "1000 * word_chars div greatest(n_words, 1)",
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more: windows are sorted by hash, equal neighbours mark their words."""

    def marked(w):
        h = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.cast("int").alias("i"))
        windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), h))

        def covered(s):
            same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return let(windows, lambda s: let(F.transform(s, lambda x: x["h"]), lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(covered(s))))

    return F.when(F.size(words) < 4, 0).otherwise(marked(words))


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without columns named as a statistic, and with the statistics of the whole text (null: of no words)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    stripped = F.regexp_replace(t, SPACE, "")
    count = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    pair = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("a"), _repeat_words(w).cast("long").alias("b")))
    line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("a"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("b")))
    upper = F.length(stripped) - F.length(F.translate(stripped, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    new = {
        "__w": pair, "word_chars": F.length(stripped).cast("long"), "n_symbols": count("#*$%&|<>").cast("long"), "__l": line,
        "n_bangs": count("!").cast("long"), "n_pipes": count("|").cast("long"), "n_upper": upper.cast("long"), "n_digits": count("0123456789").cast("long"),
    }
    names = {*BASE, *RATIOS, "n_bangs", "n_pipes", "n_upper", "n_digits", "n_lines", "base_failed", "kept"}
    own = [c for c in df.columns if c not in names]
    d = df.select(*own, *[c.alias(k) for k, c in new.items()])
    return d.select(
        *own, F.col("__w.a").alias("n_words"), "word_chars", "n_symbols", F.col("__l.b").alias("n_dup_lines"), F.col("__w.b").alias("n_repeat_words"),
        "n_bangs", "n_pipes", "n_upper", "n_digits", F.col("__l.a").alias("n_lines"),
    )


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Rule:
    """Rejects where every ``(feature, sign, threshold)`` holds; sign is ``>=`` or ``<``."""

    tests: tuple[tuple[str, str, int], ...]
    caught: int
    wrong: int

    def sql(self) -> str:
        return " and ".join(f"({RATIOS[f]}) {sign} {x}" for f, sign, x in self.tests)


def _holds(row: dict, tests) -> bool:
    return all((row[f] >= x) if sign == ">=" else (row[f] < x) for f, sign, x in tests)


def learn_rules(rows: list[dict], purity: float = 0.98, min_caught: int = 10, max_tests: int = 3, max_rules: int = 8) -> list[Rule]:
    """A decision list by sequential covering.

    ``rows`` have the ratios, ``bad`` (0/1). Two thirds grow a rule: the test with the best gain in the log odds of bad rows,
    weighted by those it keeps, is added until all covered rows are bad. The other third prunes: trailing tests go while
    the share of bad among covered rows gets no worse. A rule must catch ``min_caught`` at ``purity``; the rows it covers
    leave and the next one is grown.
    """
    import math

    out: list[Rule] = []
    left = list(rows)
    while len(out) < max_rules:
        grow, prune = [r for i, r in enumerate(left) if i % 3], [r for i, r in enumerate(left) if not i % 3]
        tests: list[tuple[str, str, int]] = []
        cover = grow
        while len(tests) < max_tests and any(not r["bad"] for r in cover):
            p0, n0 = sum(r["bad"] for r in cover), len(cover)
            best = (0.0, None)
            for f in RATIOS:
                values = sorted((r[f], r["bad"]) for r in cover)
                bad, seen = 0, 0
                for i, (v, b) in enumerate(values):
                    if i and v != values[i - 1][0]:
                        for sign, p, n in (("<", bad, seen), (">=", p0 - bad, n0 - seen)):
                            if p >= min_caught / 2:
                                gain = p * (math.log(p / n) - math.log(p0 / n0))
                                mid = v if v == values[i - 1][0] + 1 else (v + values[i - 1][0] + 1) // 2
                                if gain > best[0] + 1e-9:
                                    best = (gain, (f, sign, mid))
                    bad, seen = bad + b, seen + 1
            if not best[1]:
                break
            tests.append(best[1])
            cover = [r for r in cover if _holds(r, tests)]
        worth = lambda ts: (lambda c: (sum(r["bad"] for r in c) + 1) / (len(c) + 2))([r for r in prune if _holds(r, ts)])
        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        cover = [r for r in left if _holds(r, tests)] if tests else []
        caught = sum(r["bad"] for r in cover)
        if not cover or caught < min_caught or caught / len(cover) < purity:
            break
        out.append(Rule(tuple(tests), caught, len(cover) - caught))
        left = [r for r in left if not _holds(r, tests)]
    return out


def fit_rules(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = 6000) -> list[Rule]:
    """Rules learned from at most ``most`` labelled documents: those whose id hashes lowest. Null labels are left out."""
    ids = labels.where(f"quality is not null and {doc_id} is not null").groupBy(doc_id).agg(F.min("quality").alias("__quality")).orderBy(F.xxhash64(doc_id)).limit(most)
    # staged: else the statistics of all documents are computed below the join
    d = staged(df.select(doc_id, text).join(F.broadcast(ids), doc_id), "labelled")
    s = text_statistics(d, text).where(f"not ({BASE_FAILED})").selectExpr("cast(__quality = 0 as int) bad", doc_id, *[f"{v} as {k}" for k, v in RATIOS.items()])
    rows = sorted((r.asDict() for r in s.collect()), key=lambda r: (r[doc_id], *[r[f] for f in RATIOS]))
    return learn_rules(rows)


def judge(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``df`` with the statistics, ``base_failed``, ``rule`` (the number of the first that rejects, else null) and ``kept``.

    Base limits come first. Null and empty texts have no words, so they fail them. Long texts are counted whole, repeated rows each
    for itself; clashing columns are replaced; no rows give no rows.
    """
    s = text_statistics(df.drop("rule"), text).withColumn("base_failed", F.expr(BASE_FAILED))
    first = F.coalesce(*[F.when(F.expr(r.sql()), F.lit(i)) for i, r in enumerate(rules)]) if rules else F.lit(None).cast("int")
    return s.withColumn("rule", F.when(~F.col("base_failed"), first)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
