"""Queries over parcel input, text functions and document classes, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parcel as P
from ..functions import text as T
from ..operators import classify as C
from .fixtures import oracle, spread, view

#: Typed parcel input in several spellings, made from the parts' keys; runs on both engines.
INPUT = r"""
SELECT p_partkey AS id,
  CASE p_partkey % 5 WHEN 0 THEN ' ' || lpad(CAST(p_partkey % 499 + 1 AS STRING), 4, '0') || '-' || lpad(CAST(p_partkey % 7 AS STRING), 2, '0') || ' ' WHEN 1 THEN CAST(p_partkey % 499 + 1 AS STRING) || '.' || CAST(p_partkey % 3 AS STRING)
    WHEN 2 THEN CAST(p_partkey % 499 AS STRING) WHEN 3 THEN CAST(p_partkey % 499 + 1 AS STRING) || '//' || CAST(p_partkey % 4 AS STRING) || '/2' ELSE ' / ' || CAST(p_partkey % 9 AS STRING) END AS nr,
  CASE p_partkey % 4 WHEN 0 THEN '3-15-' || CAST(p_partkey % 97 AS STRING) WHEN 1 THEN lpad(CAST(p_partkey % 97 + 1 AS STRING), 4, '0') WHEN 2 THEN 'obr. ' || CAST(p_partkey % 97 AS STRING) || ' A' ELSE '' END AS obreb,
  split_part(' Łódź,Zażółć Gęślą,WARSZAWA,radom ', ',', CAST(p_partkey % 4 + 1 AS INT)) AS miejsc
FROM part"""


def parcel_input(spark, sf):
    from .fixtures import TABLES

    df = spark.sql(TABLES.sub(lambda m: f"FROM parquet.`{sf}/{m[1]}.parquet`", INPUT))
    return df.select("id", P.canonical(F.col("nr")).alias("canonical"), P.register_number(F.col("nr")).alias("register_number"), F.array_join(P.precinct_variants(F.col("obreb")), ",").alias("precincts"), F.array_join(P.locality_variants(F.col("miejsc")), ",").alias("localities"), P.looks_like_id(F.concat("nr", F.lit("_"))).alias("like_id"))


SQL_INPUT = f"WITH i AS ({INPUT})" + r""", c AS (
  SELECT *, regexp_replace(replace(trim(nr), ' ', ''), '[.\\/-]+', '/', 'g') AS t, trim(obreb) AS o, regexp_replace(trim(obreb), '[^0-9]', '', 'g') AS d,
    list_filter(string_split_regex(trim(obreb), '[^0-9A-Za-z]+'), lambda x: x <> '') AS ch, trim(miejsc) AS m FROM i
), s AS (
  SELECT *, CASE WHEN strpos(t, '/') > 0 THEN coalesce(nullif(substr(t, 1, strpos(t, '/') - 1), ''), '0') ELSE coalesce(nullif(t, ''), '0') END AS a,
    CASE WHEN strpos(t, '/') > 0 THEN coalesce(nullif(substr(t, strpos(t, '/') + 1), ''), '0') ELSE '0' END AS b, CASE WHEN ch[-1] SIMILAR TO '[0-9]+' THEN ch[-1] END AS l FROM c
), p AS (SELECT *, CASE WHEN CAST(nullif(d, '') AS BIGINT) < 1000 THEN lpad(CAST(CAST(d AS BIGINT) AS VARCHAR), 4, '0') ELSE CAST(CAST(nullif(d, '') AS BIGINT) AS VARCHAR) END AS dp, CASE WHEN CAST(l AS BIGINT) < 1000 THEN lpad(CAST(CAST(l AS BIGINT) AS VARCHAR), 4, '0') ELSE CAST(CAST(l AS BIGINT) AS VARCHAR) END AS lp FROM s),
v AS (SELECT *, list_filter([nullif(o, ''), nullif(d, ''), dp, l, lp], lambda x: x IS NOT NULL) AS pv, list_filter([m, lower(m), translate(replace(lower(m), 'ł', 'l'), 'ąćęńóśźż', 'acenoszz')], lambda x: x <> '') AS lv FROM p)
SELECT id, CASE WHEN b <> '0' THEN a || '/' || b ELSE a END AS canonical, CASE WHEN t = '' THEN '' WHEN strpos(t, '/') > 0 THEN a || '/' || b ELSE t END AS register_number,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(pv) + 1), lambda i: list_position(pv, pv[i]) = i), lambda i: pv[i]), ','), '') AS precincts,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(lv) + 1), lambda i: list_position(lv, lv[i]) = i), lambda i: lv[i]), ','), '') AS localities, contains(nr || '_', '.') AS like_id FROM v
"""


def text_number(spark, sf):
    df = view(spark, sf, "f_parcels").select("plot_id", F.concat(F.lit("00"), F.replace("parcel_number", F.lit("/"), F.lit(" \\ 0")), F.when(F.col("plot_id") % 3 == 0, "a").otherwise("")).alias("nr"))
    return df.select("plot_id", P.text_number(F.col("nr")).alias("parcel"))


SQL_TEXT_NUMBER = oracle("f_parcels", r"SELECT plot_id, parcel_number || CASE WHEN plot_id % 3 = 0 THEN 'a' ELSE '' END AS parcel FROM f_parcels")


def folded(spark, sf):
    return view(spark, sf, "f_lines").select("doc_id", "line_no", T.fold(F.col("line")).alias("folded"), F.round(T.similarity(F.regexp_replace(F.lower(F.substr("line", F.lit(1), F.lit(5))), "[^ -~]", "?"), F.lit("wypis")), 6).alias("similarity"), T.clean_value(F.col("line")).alias("cleaned"), T.free_value(F.col("line")).alias("free"))


MARKS = "'ąćęńóśźżäöüéèêëàâçîïôùûñíáúì', 'acenoszzaoueeeeaaciiouuniaui'"
FOLD = f"translate(translate(trim(regexp_replace(lower(line), '\\s+', ' ', 'g')), {MARKS}), '1034528', 'ioeaszb')"
SQL_FOLDED = oracle("f_lines", rf"""SELECT doc_id, line_no, {FOLD} AS folded, round(1 - levenshtein(regexp_replace(lower(substr(line, 1, 5)), '[^ -~]', '?', 'g'), 'wypis') / greatest(length(substr(line, 1, 5)), 5), 6) AS similarity,
  nullif(trim(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '[,:;.)]+$', '')), '') AS cleaned, nullif(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '^[ ,;]+|[ ,;]+$', '', 'g'), '') AS free FROM f_lines""")


def scan_penalty(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.scan_penalty(F.col("text")).alias("penalty"))


SQL_PENALTY = r"""WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż]', '', 'g')) AS l, length(regexp_replace(text, '[^0-9]', '', 'g')) AS d, length(regexp_replace(text, '\s+', '', 'g')) AS f FROM documents)
SELECT doc_id, CASE WHEN f < 60 OR l < 35 THEN 0.15 WHEN (l + d) / f < 0.55 THEN 0.15 ELSE 0.0 END AS penalty FROM c"""

_RULES = ", ".join(f"({i}, '{label}', '{phrase}', '{phrase.translate(str.maketrans('1034528', 'ioeaszb'))}', {weight}, {least})" for i, (label, phrase, weight, least) in enumerate(C.RULES))
#: Common tables up to hit(doc_id, page, line_no, label, phrase, similarity, score).
EVIDENCE = rf"""
, told AS (SELECT doc_id, page, line_no, trim(line) AS line, {FOLD} AS h FROM f_lines WHERE trim(line) <> ''),
rules(i, label, phrase, want, weight, least) AS (VALUES {_RULES}, (100, 'c', 'dzialka nr', 'dzialka nr', 0, 0.78), (101, 'c', 'obreb', 'obreb', 0, 0.78), (102, 'm', 'mpzp', 'mpzp', 0, 0.68), (103, 'w', 'wypis', 'wypis', 0, 0.76), (104, 'w', 'wyrys', 'wyrys', 0, 0.76)),
pairs AS (SELECT t.*, r.*, string_split(h, ' ') AS tokens, len(string_split(want, ' ')) AS n FROM told t CROSS JOIN rules r),
near AS (SELECT *, list_filter(list_transform(range(1, len(tokens) - n + 2), lambda k: array_to_string(tokens[k:k + n - 1], ' ')), lambda x: least(length(x), length(want)) >= least * greatest(length(x), length(want)) - 0.001) AS chunks FROM pairs),
sims AS (SELECT *, list_transform(chunks, lambda x: greatest(0.0, 1 - levenshtein(x, want) / greatest(length(x), length(want)))) AS s FROM near),
one AS (SELECT *, CASE WHEN h = '' THEN 0.0 WHEN contains(h, want) THEN 1.0 WHEN len(tokens) < n THEN greatest(0.0, 1 - levenshtein(h, want) / greatest(length(h), length(want))) ELSE coalesce(list_filter(s, lambda x: x >= least)[1], list_max(s)) END AS sim FROM sims),
met AS (SELECT * FROM one WHERE sim >= least),
hit AS (
  SELECT doc_id, page, line_no, label, phrase, sim AS similarity, CAST(round_even(weight * greatest(0.72, sim), 0) AS INT) + CASE WHEN label = 'MPZP_WYPIS_WYRYS' AND EXISTS (SELECT 1 FROM met c WHERE c.label = 'c' AND c.doc_id = m.doc_id AND c.line_no = m.line_no) THEN 25 ELSE 0 END AS score FROM met m WHERE i < 100
  UNION ALL SELECT doc_id, page, line_no, 'MPZP_OGOLNY', '§ mpzp', 1.0, 60 FROM met WHERE label = 'm' AND contains(line, '§')
  UNION ALL SELECT DISTINCT doc_id, page, line_no, 'MPZP_OGOLNY', 'wypis/wyrys', 1.0, -180 FROM met WHERE label = 'w')
"""
SUMS = """, every AS (SELECT DISTINCT doc_id FROM f_lines), sums AS (SELECT e.doc_id, CAST(coalesce(sum(score) FILTER (label = 'MPZP_WYPIS_WYRYS'), 0) AS BIGINT) AS mpzp_wypis_wyrys, CAST(coalesce(sum(score) FILTER (label = 'WZ_DECYZJA'), 0) AS BIGINT) AS wz_decyzja, CAST(coalesce(sum(score) FILTER (label = 'MPZP_OGOLNY'), 0) AS BIGINT) AS mpzp_ogolny FROM every e LEFT JOIN hit USING (doc_id) GROUP BY 1)"""
RANKED = """, long AS (SELECT doc_id, mpzp_wypis_wyrys AS s, 0 AS i, 'MPZP_WYPIS_WYRYS' AS label FROM sums UNION ALL SELECT doc_id, wz_decyzja, 1, 'WZ_DECYZJA' FROM sums UNION ALL SELECT doc_id, mpzp_ogolny, 2, 'MPZP_OGOLNY' FROM sums),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i) AS r FROM long),
best AS (SELECT a.doc_id, a.label AS winner, a.s AS winner_score, b.s AS second_score, a.s < 200 OR (a.s >= 220 AND b.s >= 220 AND a.s - b.s < 60) AS needs_review FROM placed a JOIN placed b USING (doc_id) WHERE a.r = 1 AND b.r = 2)"""
PENALTY = r"CASE WHEN length(regexp_replace(text, '\s+', '', 'g')) < 60 OR length(regexp_replace(text, '[^A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż]', '', 'g')) < 35 THEN 0.15 WHEN (length(regexp_replace(text, '[^A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż0-9]', '', 'g'))) / length(regexp_replace(text, '\s+', '', 'g')) < 0.55 THEN 0.15 ELSE 0.0 END"


def evidence(spark, sf):
    return C.evidence(spread(view(spark, sf, "f_lines"))).withColumn("similarity", F.round("similarity", 9))


def class_scores(spark, sf):
    return C.class_scores(spread(view(spark, sf, "f_lines")))


def winners(spark, sf):
    return C.winners(class_scores(spark, sf))


def _top(spark, sf):
    return C.top_text(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lit(1).alias("page"), "text"))


def final_class(spark, sf):
    return C.final_class(winners(spark, sf), _top(spark, sf))


def overridden(spark, sf):
    said = _top(spark, sf).select("doc_id", F.when(F.col("doc_id") % 2 == 0, "WZ_DECYZJA").otherwise("INNE").alias("label"), (F.col("doc_id") % 10 / 10.0).alias("confidence"))
    return C.final_class(winners(spark, sf), _top(spark, sf), said)


def top_evidence(spark, sf):
    return C.top_evidence(C.evidence(spread(view(spark, sf, "f_lines")))).select("doc_id", "rank", "label", "phrase", "line_no", "score")


#: The top text: the first 35 lines that aren't blank, with single spaces, up to 1,200 characters.
TOP = r"(SELECT doc_id, substr(trim(regexp_replace(array_to_string(list_filter(list_transform(string_split_regex(text, '[\r\n]+'), lambda x: trim(x)), lambda x: x <> '')[1:35], chr(10)), '\s+', ' ', 'g')), 1, 1200) AS text FROM documents)"
FINAL = f", t AS {TOP}"
def key_lines(spark, sf):
    """Each document's third line with its blanks doubled and vowels changed, as a model would quote it."""
    df = view(spark, sf, "f_lines").where("line_no = 2")
    return df.select("doc_id", F.translate("line", "ao", "eu").alias("key_line"))


def mapped(spark, sf):
    return C.mapped_lines(key_lines(spark, sf), view(spark, sf, "f_lines")).select("doc_id", "line", "score")


QUERIES = {
    "f25_top_text": _top, "j6_mapped_lines": mapped,
    "f1_f4_parcel_input": parcel_input, "f5_text_parcel": text_number, "f12_f17_folded_text": folded, "p14_scan_penalty": scan_penalty,
    "j12_rule_evidence": evidence, "a1_class_scores": class_scores, "a2_class_winner": winners, "a3_final_class": final_class, "p23_label_override": overridden, "t3_top_evidence": top_evidence,
}
ORACLE = {
    "f25_top_text": f"SELECT * FROM {TOP}",
    "j6_mapped_lines": oracle("f_lines", f""", k AS (SELECT doc_id, {FOLD.replace('lower(line)', "lower(translate(line, 'ao', 'eu'))")} AS want, translate(line, 'ao', 'eu') AS key_line FROM f_lines WHERE line_no = 2), l AS (SELECT doc_id, page, line_no, trim(line) AS line, {FOLD} AS folded FROM f_lines),
  p AS (SELECT k.doc_id, key_line, page, line_no, line, 1 - levenshtein(folded, want) / greatest(length(folded), length(want)) AS sim FROM k JOIN l USING (doc_id) WHERE want <> '' AND folded <> '' AND 2 * least(length(folded), length(want)) >= greatest(length(folded), length(want)))
  SELECT doc_id, line, CAST(round_even(sim * 100, 0) AS INT) AS score FROM p WHERE sim >= 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id, key_line ORDER BY sim DESC, page, line_no) = 1"""),
    "f1_f4_parcel_input": SQL_INPUT, "f5_text_parcel": SQL_TEXT_NUMBER, "f12_f17_folded_text": SQL_FOLDED, "p14_scan_penalty": SQL_PENALTY,
    "j12_rule_evidence": oracle("f_lines", EVIDENCE + " SELECT doc_id, page, line_no, label, phrase, round(similarity, 9) AS similarity, score FROM hit"),
    "a1_class_scores": oracle("f_lines", EVIDENCE + SUMS + " SELECT * FROM sums"),
    "a2_class_winner": oracle("f_lines", EVIDENCE + SUMS + RANKED + " SELECT * FROM best"),
    "a3_final_class": oracle("f_lines", EVIDENCE + SUMS + RANKED + FINAL + f" SELECT doc_id, CASE WHEN winner_score < 1 THEN 'INNE' ELSE winner END AS file_type, round(greatest(0.0, least(1.0, winner_score / 420.0) - {PENALTY}), 3) AS confidence FROM best JOIN t USING (doc_id)"),
    "p23_label_override": oracle("f_lines", EVIDENCE + SUMS + RANKED + FINAL + f""", o AS (SELECT doc_id, text, winner, winner_score, (needs_review OR length(text) < 120) AND doc_id % 10 / 10.0 >= 0.65 AS use FROM best JOIN t USING (doc_id)),
  u AS (SELECT doc_id, text, CASE WHEN use THEN CASE WHEN doc_id % 2 = 0 THEN 'WZ_DECYZJA' ELSE 'INNE' END ELSE winner END AS winner, CASE WHEN use THEN greatest(winner_score, CAST(round_even(doc_id % 10 / 10.0 * 420, 0) AS INT)) ELSE winner_score END AS winner_score FROM o)
  SELECT doc_id, CASE WHEN winner_score < 1 THEN 'INNE' ELSE winner END AS file_type, round(greatest(0.0, least(1.0, winner_score / 420.0) - {PENALTY}), 3) AS confidence FROM u"""),
    "t3_top_evidence": oracle("f_lines", EVIDENCE + " SELECT doc_id, rank, label, phrase, line_no, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page, line_no, label, phrase) AS rank FROM hit) WHERE rank <= 8"),
}
