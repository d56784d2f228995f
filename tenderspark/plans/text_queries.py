"""Queries through the full-text index of titles: equal to the scans, and relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.textindex import Autocompletion, TextIndex
from ..sources.binding import notices, table
from ..streaming.ingest import scratch
from .registry import ORACLE_SQL, once, query

def _title_index(spark, sf_dir) -> TextIndex:
    return TextIndex.build(notices(spark, sf_dir, cpv=True), "notice_id", "title", scratch(spark))


def title_index(spark, sf_dir) -> TextIndex:
    return once(spark, sf_dir, _title_index)


def _label_grams(spark, sf_dir) -> Autocompletion:
    sources = {"notice": ("part", "p_name"), "supplier": ("supplier", "s_name"), "procurer": ("customer", "c_name")}
    return Autocompletion.build({kind: table(spark, sf_dir, t).select(F.col(c).alias("label")) for kind, (t, c) in sources.items()}, scratch(spark))


def label_grams(spark, sf_dir) -> Autocompletion:
    return once(spark, sf_dir, _label_grams)


def _awards(spark, sf_dir, found):
    n = notices(spark, sf_dir, cpv=True).where("notice_type = 'contract_award'")
    return n.join(found, n.notice_id == found.doc, "left_semi").select("notice_id", "title", "publication_date")


@query(ORACLE_SQL["search_phrase"], bound=False)
def search_phrase_indexed(spark, sf_dir):
    return _awards(spark, sf_dir, title_index(spark, sf_dir).matches('"small ring"'))


@query(ORACLE_SQL["search_wildcard"], bound=False)
def search_wildcard_indexed(spark, sf_dir):
    return _awards(spark, sf_dir, title_index(spark, sf_dir).matches("wid*t"))


@query(ORACLE_SQL["search_fuzzy"], bound=False)
def search_fuzzy_indexed(spark, sf_dir):
    return _awards(spark, sf_dir, title_index(spark, sf_dir).matches("Gizmá"))


#: Tokens of titles with their places, frequencies and lengths.
WORDS = """, w AS (SELECT notice_id, unnest(t) AS token, unnest(range(len(t))) AS pos, len(t) AS dl FROM (SELECT notice_id, string_split(strip_accents(lower(title)), ' ') AS t FROM n)),
    f AS (SELECT token, count(DISTINCT notice_id) AS n_docs FROM w GROUP BY 1)"""


@query(WORDS + " SELECT token, n_docs FROM f")
def text_terms(spark, sf_dir):
    return title_index(spark, sf_dir).terms().select("token", "n_docs")


@query(WORDS + " SELECT 'wigdet' AS word, token, levenshtein(token, 'wigdet') AS edits, n_docs FROM f WHERE levenshtein(token, 'wigdet') <= 2")
def fuzzy_terms(spark, sf_dir):
    return title_index(spark, sf_dir).near_terms("wigdet").select("word", "token", F.col("edits").cast("long").alias("edits"), "n_docs")


#: BM25 of "red widget": the phrase three times, the tokens near its words less their edits, and a constant for a
#: beginning, which no token has, as the query holds a blank.
RELEVANCE = f"""{WORDS}, q AS (SELECT * FROM (VALUES ('red', 1), ('widget', 2)) AS q(word, most)),
    totals AS (SELECT count(DISTINCT notice_id) AS docs, count(*) / count(DISTINCT notice_id) AS average FROM w),
    tf AS (SELECT notice_id, token, dl, count(*) AS times FROM w GROUP BY ALL),
    near AS (SELECT notice_id, (1 - levenshtein(token, word) / least(length(token), length(word))) * ln(1 + (docs - n_docs + 0.5::DOUBLE) / (n_docs + 0.5::DOUBLE))
      * times / (times + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / average)) AS score
      FROM tf JOIN f USING (token) JOIN q ON levenshtein(token, word) <= most, totals),
    pairs AS (SELECT a.notice_id, a.dl, count(*) AS times FROM w a JOIN w b ON a.notice_id = b.notice_id AND b.pos = a.pos + 1 WHERE a.token = 'red' AND b.token = 'widget' GROUP BY ALL),
    whole AS (SELECT notice_id, 3.0::DOUBLE * (SELECT sum(ln(1 + (docs - n_docs + 0.5::DOUBLE) / (n_docs + 0.5::DOUBLE))) FROM f WHERE token IN ('red', 'widget'))
      * times / (times + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / average)) AS score FROM pairs, totals)"""


@query(RELEVANCE + " SELECT notice_id AS doc, round(sum(score), 9) AS score FROM (SELECT * FROM near UNION ALL SELECT * FROM whole) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def search_relevance(spark, sf_dir):
    return title_index(spark, sf_dir).relevance("red widget", 50)


@query(ORACLE_SQL["autocomplete"], bound=False)
def autocomplete_indexed(spark, sf_dir):
    return label_grams(spark, sf_dir).complete("bo").select("kind", "label")


@query(ORACLE_SQL["autocomplete_fuzzy"], bound=False)
def autocomplete_fuzzy_indexed(spark, sf_dir):
    return label_grams(spark, sf_dir).complete("Rímg", 20, edits=1).where("kind = 'notice'").select("kind", "label")
