"""URL filter: rules first, then word segmentation and naive Bayes.

A rule names a host and a path prefix; it fits the host and its subdomains, and
the longest rule that fits decides. Other urls are judged by a multinomial
naive Bayes over the words of host and path.

* Segmentation. Host and path are split at everything but letters; each
  distinct piece is cut once by a Viterbi search over unigram probabilities: a
  piece counts once for each host it is found on (all hosts of the table), a
  lexicon word once more. A piece of one host only is no evidence of itself. A
  stretch that is no known word costs what its letters cost, and every cut costs
  ``CUT``, so names are cut only where known words explain them better than
  letters do; short ones do so next to other known words only.
* Classification. The words of urls that a rule blocks or allows are counted
  (words of the rules themselves are left out: they say nothing beyond the rule),
  the larger class scaled down to the smaller, on top of two short lists of
  labelled topic words (fixed values below). A word seen in neither weighs nothing.

Both are joins and aggregates of Spark over the whole table; Python cuts one
piece at a time from its own substrings' counts. The work grows with the length
of a url, a megabyte in one piece included.

Edge cases: a null url or one without ``://`` has empty host and path, fits no
rule and is judged on no words (allow); repeated rows are each judged; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroll.llm.common import identified, materialize

#: Fixed values: (host, path prefix, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Labelled training words, unwanted topics and common words of hosts and paths.
UNWANTED = """
adult porn sex xxx nude escort cams casino casinos poker bet bets betting gamble gambling jackpot slots roulette lottery win
winner spam spammer farm clickbait pills pill pharma viagra cialis cheap replica discount ads ad adserver track tracker tracking
banner popup malware phishing crack cracked warez keygen torrent loan loans payday free bonus miracle hookup dating
"""
WANTED = """
news mobile shop docs wiki help support forum mail school university library science history sport music art food
travel health weather book books photo video report article post page topic about contact world local city data code
open media press journal review guide learn home garden family work people party water light house land green blue
"""
#: Parts of any address, in the training text of both classes.
NEUTRAL = """
www m blog example com net org html php en fr de es feed ref utm source index page
"""
#: Nats a cut, a letter of an unknown stretch and the stretch itself cost; length of words looked for.
CUT, LETTER, UNKNOWN, LONGEST = 7.0, 2.9, 2.3, 24
#: Occurrences a list word stands for, pseudo-count of naive Bayes, share of unwanted urls expected.
LISTED, SMOOTH, PRIOR = 10.0, 1.0, 0.1
#: Spark's pattern of a piece; a piece in parts of 64 letters, each with what follows it.
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
PARTS = r"(?s)(.{1,64})(?=(.{0,23}))"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path) and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, prefix, action in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(prefix))
        name = F.when(fits, F.lit(rule_host + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


class Segmenter:
    """Unigram Viterbi: the cheapest cut of a name, ``counts`` of ``total`` known words given."""

    def __init__(self, counts: dict[str, float], total: float) -> None:
        self.cost = {w: math.log(total / c) for w, c in counts.items()}

    @staticmethod
    def unknown(length: int) -> float:
        return UNKNOWN + LETTER * length

    def words(self, name: str) -> list[str]:
        if not self.cost:
            return [name] if name else []
        n, get = len(name), self.cost.get
        # The first word has no cut before it. An unknown stretch may be of any
        # length: ``open_`` is the cheapest place for one to have begun.
        best, back = [-CUT] + [math.inf] * n, [0] * (n + 1)
        open_, begin = best[0], 0
        for end in range(1, n + 1):
            if best[end - 1] - LETTER * (end - 1) < open_ - 1e-9:
                open_, begin = best[end - 1] - LETTER * (end - 1), end - 1
            cost, start = open_ + CUT + UNKNOWN + LETTER * end, begin
            for s in range(max(0, end - LONGEST), end):
                price = get(name[s:end])
                if price is not None and best[s] + CUT + price < cost:
                    cost, start = best[s] + CUT + price, s
            best[end], back[end] = cost, start
        out, end = [], n
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]


def _pieces(urls: DataFrame) -> DataFrame:
    """Every piece of each url's host and path with its place."""
    text = F.lower(F.concat_ws(" ", "host", "path"))
    return urls.select("row", "host", F.posexplode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("pos", "piece"))


def _substrings(names: DataFrame) -> DataFrame:
    """(number, word): the distinct stretches of up to ``LONGEST`` letters of each piece, part by part."""
    part = lambda k: F.regexp_extract_all("piece", F.lit(PARTS), F.lit(k))
    parts = names.select("number", F.explode(F.arrays_zip(part(1).alias("own"), part(2).alias("rest"))).alias("p"))
    whole = parts.select("number", F.length("p.own").alias("starts"), F.concat("p.own", "p.rest").alias("text"))
    stretches = F.expr(f"flatten(transform(sequence(1, starts), s -> transform(sequence(1, least({LONGEST}, length(text) - s + 1)),"
                       " n -> substring(text, s, n))))")
    return whole.select("number", F.explode(F.array_distinct(stretches)).alias("word"))


def cut_pieces(pieces: DataFrame, lexicon: set[str]) -> DataFrame:
    """(piece, cut) of each distinct piece: the words it is cut into."""
    counted = pieces.groupBy("piece").agg(F.count_distinct("host").alias("hosts")).withColumn("number", F.monotonically_increasing_id())
    names = materialize(counted, "pieces")
    total = float((names.agg(F.sum("hosts")).first()[0] or 0) + len(lexicon))
    known = names.where(F.length("piece") <= LONGEST).select(F.col("piece").alias("word"), "hosts", F.col("number").alias("own"))
    found = _substrings(names).join(known, "word").where("number != own or hosts > 1")
    # A stretch of several parts of a long piece is one word.
    found = found.groupBy("number").agg(F.collect_set(F.struct("word", "hosts")).alias("known"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, known in zip(batch.column("piece").to_pylist(), batch.column("known").to_pylist(), strict=True):
                counts = {w: 1.0 for w in lexicon}
                for k in known or ():
                    counts[k["word"]] = counts.get(k["word"], 0.0) + k["hosts"]
                out.append(Segmenter(counts, total).words(name))
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(out, pa.list_(pa.string()))], ["piece", "cut"])

    return materialize(names.join(found, "number", "left").select("piece", "known").mapInArrow(cut, "piece string, cut array<string>"), "cuts")


def word_odds(cuts: DataFrame, pieces: DataFrame, judged: DataFrame, rules: tuple, unwanted: set[str], wanted: set[str]) -> DataFrame:
    """(word, odds): log odds of a word in unwanted urls, from the urls that
    rules judge (``row``, ``action``) and the two lists."""
    own = {w for host, path, _ in rules for w in re.findall(r"[a-z]+", f"{host} {path}".lower())}
    by_piece = pieces.join(judged.where("action IS NOT NULL"), "row").groupBy("piece", "action").agg(F.count("*").alias("n"))
    words = by_piece.join(cuts, "piece").select(F.explode("cut").alias("word"), "action", "n").where(~F.col("word").isin(list(own)))
    counts = materialize(words.groupBy("word").agg(F.sum(F.when(F.col("action") == "block", F.col("n")).otherwise(0)).alias("blocked"),
                                                   F.sum(F.when(F.col("action") == "allow", F.col("n")).otherwise(0)).alias("allowed")), "word-counts")
    blocked, allowed = counts.agg(F.sum("blocked"), F.sum("allowed")).first()
    least = min(blocked or 0, allowed or 0)
    # Both classes as if they were as large as the smaller one.
    scale = least / blocked if least else 0.0, least / allowed if least else 0.0
    listed = cuts.sparkSession.createDataFrame(
        [(w, LISTED * (w in unwanted), LISTED * (w in wanted)) for w in sorted(unwanted | wanted)], "word string, bad double, good double")
    both = counts.join(listed, "word", "full")
    side = lambda seen, k, given: F.coalesce(F.col(seen) * F.lit(scale[k]), F.lit(0.0)) + F.coalesce(given, F.lit(0.0)) + F.lit(SMOOTH)
    return both.select("word", (F.log(side("blocked", 0, "bad")) - F.log(side("allowed", 1, "good"))).alias("odds"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``, ``words``, ``log_odds``."""
    rows = identified(pages, id_col, url_col).toDF("id", "url")
    urls = materialize(rows.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                                   F.monotonically_increasing_id().alias("row")), "urls")
    unwanted, wanted = set(UNWANTED.split()), set(WANTED.split())
    pieces = _pieces(urls)
    cuts = cut_pieces(pieces, unwanted | wanted | set(NEUTRAL.split()))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    odds = word_odds(cuts, pieces, urls.select("row", action.alias("action")), rules, unwanted, wanted)
    # What a piece adds to the score, once for each distinct piece.
    weighed = (cuts.select("piece", F.explode("cut").alias("word")).join(odds, "word").groupBy("piece")
               .agg(F.sum(F.round(F.col("odds") * 2**20).cast("long")).alias("odds")))
    scored = cuts.join(weighed, "piece", "left")
    found = pieces.select("row", "pos", "piece").join(scored, "piece").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("pos", "cut"))).alias("cuts"), F.sum("odds").alias("odds"))
    prior = math.log(PRIOR / (1 - PRIOR))
    judged = urls.join(found.select("row", F.flatten("cuts.cut").alias("words"), "odds"), "row", "left").select(
        "id", "host", "path", F.coalesce("words", F.array().cast("array<string>")).alias("words"),
        (F.coalesce("odds", F.lit(0)) / 2**20 + prior).alias("log_odds"))
    by_method = F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
                         F.coalesce(action, by_method).alias("verdict"), "words", "log_odds")
