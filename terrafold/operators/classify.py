"""Document classes: every line is scored against a small, fixed table of weighted phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import LETTERS, LOOKALIKES, fold, scan_penalty, squeeze

#: Label, phrase, weight, least similarity.
RULES = [
    ("MPZP_WYPIS_WYRYS", "wypis i wyrys", 150, 0.8),
    ("MPZP_WYPIS_WYRYS", "wypis z miejscowego planu", 140, 0.82),
    ("MPZP_WYPIS_WYRYS", "wyrys z miejscowego planu", 140, 0.82),
    ("MPZP_WYPIS_WYRYS", "miejscowy plan zagospodarowania przestrzennego", 90, 0.78),
    ("MPZP_WYPIS_WYRYS", "mpzp", 70, 0.68),
    ("MPZP_WYPIS_WYRYS", "ustalenia planu", 40, 0.82),
    ("MPZP_WYPIS_WYRYS", "teren oznaczony symbolem", 40, 0.8),
    ("WZ_DECYZJA", "decyzja o warunkach zabudowy", 180, 0.8),
    ("WZ_DECYZJA", "decyzja o ustaleniu warunkow zabudowy", 180, 0.8),
    ("WZ_DECYZJA", "warunki zabudowy", 100, 0.8),
    ("WZ_DECYZJA", "ustalam warunki zabudowy", 90, 0.8),
    ("WZ_DECYZJA", "na podstawie art 59", 90, 0.8),
    ("WZ_DECYZJA", "samorzadowe kolegium odwolawcze", 70, 0.8),
    ("WZ_DECYZJA", "sko", 70, 0.66),
    ("WZ_DECYZJA", "pouczenie", 30, 0.86),
    ("WZ_DECYZJA", "odwolanie", 30, 0.86),
    ("MPZP_OGOLNY", "uchwala nr", 160, 0.8),
    ("MPZP_OGOLNY", "w sprawie uchwalenia miejscowego planu", 170, 0.8),
    ("MPZP_OGOLNY", "dziennik urzedowy wojewodztwa", 170, 0.8),
    ("MPZP_OGOLNY", "rada gminy", 60, 0.82),
    ("MPZP_OGOLNY", "rada miasta", 60, 0.82),
]
LABELS = ("MPZP_WYPIS_WYRYS", "WZ_DECYZJA", "MPZP_OGOLNY")


FOLDED = str.maketrans(*LOOKALIKES)


#: Phrases that change a score rather than count themselves: of a parcel, the plan's short name, of an extract.
SIGNS = [("parcel", "dzialka nr", 0, 0.78), ("parcel", "obreb", 0, 0.78), ("plan", "mpzp", 0, 0.68), ("extract", "wypis", 0, 0.76), ("extract", "wyrys", 0, 0.76)]


#: What lines are looked for: of each rule its number's phrase, as folded, and least similarity.
WANTED = [(phrase.translate(FOLDED), least) for _, phrase, _, least in RULES + SIGNS]
#: The letters of the phrases, eight to a long: a run's and a phrase's counts of them are one byte each.
WANTED_LETTERS = sorted(set("".join(want for want, _ in WANTED)))
EIGHTS = ["".join(WANTED_LETTERS[k : k + 8]) for k in range(0, len(WANTED_LETTERS), 8)]
#: A one in each byte of a long: a long of small bytes by this number has their sum in its highest byte.
ONES = np.uint64(0x0101010101010101)
#: Lines are taken together up to so many characters, which bounds a task's memory.
CHUNK = 1 << 19


def places(text: str, want: str) -> Iterator[int]:
    at = text.find(want)
    while at >= 0:
        yield at
        at = text.find(want, at + 1)


def could_meet(lines: list[str]) -> Iterator[tuple[int, int, int, str]]:
    """row, rule, at, run of the runs of a rule's number of words that could be similar enough, by their lengths and letters alone; a phrase within a line is at -1.

    A line of fewer words is one run, at 0. A run that lacks d of a phrase's letters is d edits away at least, and so is one with d too many.
    """
    text = "\n".join(lines)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    stops = np.flatnonzero((codes == ord(" ")) | (codes == ord("\n")))
    starts, ends = np.append(0, stops + 1), np.append(stops, len(codes))
    row = np.append(0, np.cumsum(codes[stops] == ord("\n")))
    first = np.searchsorted(row, np.arange(len(lines) + 1))
    for rule, (want, _) in enumerate(WANTED):
        found = np.fromiter(places(text, want), int)
        yield from ((r, rule, -1, want) for r in np.unique(row[np.searchsorted(starts, found, "right") - 1]).tolist())
    low, so_far = np.minimum(codes, 128).astype(np.uint8), []
    for eight in EIGHTS:
        unit = np.zeros(129, np.uint64)
        unit[[ord(c) for c in eight]] = [1 << 8 * j for j in range(len(eight))]
        so_far.append(np.append(np.uint64(0), np.cumsum(unit[low])))
    word = np.arange(len(starts))
    left = first[row + 1] - word
    for n in sorted({want.count(" ") + 1 for want, _ in WANTED}):
        begins = np.flatnonzero((left >= n) | (word == first[row]))
        size = np.minimum(left[begins], n)
        s, e = starts[begins], ends[begins + size - 1]
        length, have = e - s, [c[e] - c[s] for c in so_far]
        for rule, (want, least) in enumerate(WANTED):
            if want.count(" ") + 1 == n:
                i = np.flatnonzero((length >= len(want) * least - 1e-9) & (length <= len(want) / least + 1e-9))
                lacks = np.maximum(length[i] - len(want), 0)
                for eight, counts in zip(EIGHTS, have):
                    need = np.uint64(sum(want.count(c) << 8 * j for j, c in enumerate(eight)))
                    short = (need | ONES << 7) - counts[i]  # a byte keeps its high bit where the run has no more than the phrase
                    lacks += ((short & (short >> 7 & ONES) * 127) * ONES >> 56).astype(np.int64)
                for k in i[lacks <= (1 - least) * np.maximum(length[i], len(want)) + 1e-9].tolist():
                    yield int(row[begins[k]]), rule, int(begins[k] - first[row[begins[k]]]) + 1 if size[k] == n else 0, text[s[k] : e[k]]


def near_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: what could_meet finds in the last column, folded, with the other columns."""
    for batch in batches:
        chunk = np.cumsum(pc.utf8_length(batch.column("folded")).to_numpy()) // CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            found = list(could_meet(part.column("folded").to_pylist())) if b > a else []
            if found:
                rows, *told = zip(*found)
                kept = part.take(pa.array(rows, pa.int64())).drop_columns(["folded"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(told[0], pa.int32()), pa.array(told[1], pa.int32()), pa.array(told[2], pa.string())], [*kept.schema.names, "rule", "at", "run"])


def meetings(told: DataFrame) -> DataFrame:
    """doc_id, page, line_no, mark, rule, similarity of every rule that a line meets; told: the folded lines, mark: whether the line has a §.

    A phrase within the line counts 1, else the first run of as many words that is similar enough counts its similarity. Only runs whose
    lengths and letters allow it become rows; their edit distances decide.
    """
    keys = ["doc_id", "page", "line_no", "mark"]
    told = told.select(*keys, "folded")
    of = lambda k: F.get(F.array(*(F.lit(w[k]) for w in WANTED)), F.col("rule"))
    some = told.mapInArrow(near_runs, StructType([*told.drop("folded").schema, *StructType.fromDDL("rule int, at int, run string")])).withColumns({"want": of(0), "least": of(1)})
    alike = 1 - F.levenshtein("run", "want") / F.greatest(F.length("run"), F.length("want"))
    return some.withColumn("similarity", alike).where("similarity >= least").groupBy(*keys, "rule").agg(F.min_by("similarity", "at").alias("similarity"))


def evidence(lines: DataFrame) -> DataFrame:
    """doc_id, page, line_no, label, phrase, similarity, score of every rule that a line (doc_id, page, line_no, line) meets."""
    told = lines.select("doc_id", "page", "line_no", F.col("line").contains("§").alias("mark"), fold(F.col("line")).alias("folded"))  # a filter by folded would fold twice
    rules = RULES + SIGNS
    column = lambda k: F.array(*(F.lit(r[k]) for r in rules))
    one = F.struct(F.get(column(0), F.col("rule")).alias("label"), F.get(column(1), F.col("rule")).alias("phrase"), F.get(column(2), F.col("rule")).alias("weight"), "similarity")
    told = meetings(told).groupBy("doc_id", "page", "line_no", "mark").agg(F.collect_list(one).alias("met"))
    sign = lambda name: F.exists("met", lambda r: r["label"] == name)
    hit = lambda label, phrase, sim, score: F.struct(label.alias("label"), phrase.alias("phrase"), sim.cast("double").alias("similarity"), score.cast("int").alias("score"))
    counted = F.transform(F.filter("met", lambda r: r["weight"] > 0), lambda r: hit(r["label"], r["phrase"], r["similarity"], F.bround(r["weight"] * F.greatest(F.lit(0.72), r["similarity"])) + F.when((r["label"] == LABELS[0]) & sign("parcel"), 25).otherwise(0)))
    extra = F.array_compact(F.array(
        F.when(sign("plan") & F.col("mark"), hit(F.lit(LABELS[2]), F.lit("§ mpzp"), F.lit(1), F.lit(60))),
        F.when(sign("extract"), hit(F.lit(LABELS[2]), F.lit("wypis/wyrys"), F.lit(1), F.lit(-180))),
    ))
    return told.select("doc_id", "page", "line_no", F.explode(F.concat(counted, extra)).alias("hit")).select("doc_id", "page", "line_no", "hit.*")


def class_scores(lines: DataFrame) -> DataFrame:
    """doc_id and one column of summed scores a class; documents without evidence have zeros."""
    found = evidence(lines)
    sums = found.groupBy("doc_id").agg(*(F.coalesce(F.sum(F.when(F.col("label") == x, F.col("score"))), F.lit(0)).alias(x.lower()) for x in LABELS))
    every = lines.select("doc_id").distinct()
    return every.join(sums.hint("merge"), "doc_id", "left").select("doc_id", *(F.coalesce(x.lower(), F.lit(0)).alias(x.lower()) for x in LABELS))


def winners(scores: DataFrame) -> DataFrame:
    """The best class (ties: the order of LABELS), the two best scores, and whether a person should look."""
    ranked = F.array_sort(F.array(*(F.struct((-F.col(x.lower())).alias("s"), F.lit(i).alias("i"), F.lit(x).alias("label")) for i, x in enumerate(LABELS))))
    out = scores.withColumn("r", ranked).select("doc_id", F.col("r")[0]["label"].alias("winner"), (-F.col("r")[0]["s"]).alias("winner_score"), (-F.col("r")[1]["s"]).alias("second_score"))
    close = (F.col("winner_score") >= 220) & (F.col("second_score") >= 220) & (F.col("winner_score") - F.col("second_score") < 60)
    return out.withColumn("needs_review", (F.col("winner_score") < 200) | close)


def final_class(ranked: DataFrame, top_text: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """doc_id, file_type, confidence; top_text: doc_id, text; external: doc_id, label, confidence of another classifier, used where the case is open and it is sure."""
    out = ranked.join(top_text.hint("merge"), "doc_id", "left")
    if external is not None:
        said = external.select("doc_id", F.col("label").alias("x_label"), F.col("confidence").alias("x_conf"))
        out = out.join(said.hint("merge"), "doc_id", "left")
        use = (F.col("needs_review") | (F.length(F.coalesce("text", F.lit(""))) < 120)) & (F.col("x_conf") >= 0.65)
        out = out.withColumn("winner", F.when(use, F.col("x_label")).otherwise(F.col("winner"))).withColumn("winner_score", F.when(use, F.greatest("winner_score", F.bround(F.col("x_conf") * 420).cast("int"))).otherwise(F.col("winner_score")))
    kind = F.when(F.col("winner_score") < 1, "INNE").otherwise(F.col("winner"))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("winner_score") / 420.0) - scan_penalty(F.col("text")))
    return out.select("doc_id", kind.alias("file_type"), F.round(sure, 3).alias("confidence"))


def top_evidence(found: DataFrame, k: int = 8) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "page", "line_no", "label", "phrase")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_text(pages: DataFrame) -> DataFrame:
    """doc_id, text: the first 35 lines of page 1, and of page 2 where page 1 has under 180 letters, with single spaces, at most 1,200 characters.

    The cut is the feature: a classifier's confidence rests on a document's head.
    """
    head = pages.where("page <= 2").groupBy("doc_id").agg(F.max(F.when(F.col("page") == 1, F.struct("text"))).alias("a"), F.max(F.when(F.col("page") == 2, F.struct("text"))).alias("b"))
    top = lambda c: F.array_join(F.slice(F.filter(F.transform(F.split(c, r"[\r\n]+"), lambda x: F.trim(x)), lambda x: x != ""), 1, 35), "\n")
    few = F.regexp_count(F.coalesce("a.text", F.lit("")), F.lit(f"[{LETTERS}]")) < 180
    return head.select("doc_id", F.substr(squeeze(F.concat_ws(" ", top(F.col("a.text")), F.when(few, top(F.col("b.text"))))), F.lit(1), F.lit(1200)).alias("text"))


def mapped_lines(key_lines: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, key_line, page, line, score (percent): the document's line most similar to each key line, the first of equals, from half alike on.

    Edits are counted up to a fifth of the length first, in a band of the table; up to half of it only for key lines that have no line so close.
    """
    asked = key_lines.select("doc_id", "key_line", fold(F.col("key_line")).alias("want")).where("want <> ''")
    told = lines.select("doc_id", "page", "line_no", F.trim("line").alias("line"), fold(F.col("line")).alias("folded"))  # a filter by folded would fold twice
    longer = F.greatest(F.length("folded"), F.length("want"))
    near = F.least(F.length("folded"), F.length("want")) * 2 >= longer  # else they can't be half alike
    within = lambda share: F.expr(f"levenshtein(folded, want, cast(floor(longer_ * {share} + 1e-9) as int))")
    alike = lambda edits: F.when(edits >= 0, 1 - edits / F.col("longer_"))
    pairs = asked.join(told.hint("merge"), "doc_id").where(near).withColumn("longer_", longer).withColumn("few_", within(0.2))
    close = F.max("few_").over(Window.partitionBy("doc_id", "key_line")) >= 0  # then no other line can be the most similar
    pairs = pairs.withColumn("close_", close).withColumn("sim", F.when(F.col("close_"), alike(F.col("few_"))).otherwise(alike(within(0.5)))).where("sim >= 0.5")
    best = pairs.groupBy("doc_id", "key_line").agg(F.max_by(F.struct("page", "line", "sim"), F.struct("sim", -F.col("page"), -F.col("line_no"))).alias("b"))
    return best.select("doc_id", "key_line", "b.page", "b.line", F.bround(F.col("b.sim") * 100).cast("int").alias("score"))
