"""Operator 8: URL rules, then host names split into words for a naive Bayes verdict.

Rules decide first, by columns alone. For the rest, concatenated host names are split by the most
likely sequence of words (unigram Viterbi), and a multinomial naive Bayes model scores the words of
host and path. Both models are learnt from the whole table, by aggregations that count each different host once.

- Words for the splits: those that stand alone, in paths and beside hyphens, and the seeds. Each run of letters
  of a host meets the words that are in it by a join of its substrings, so no vocabulary is cut.
- Classes: hosts whose words hold more BLOCK_WORDS than ALLOW_WORDS count as blocked, those with fewer as
  allowed, and all others by what the model says of them, in ROUNDS rounds of expectation and maximisation.
  P(word | class) is interpolated with the frequency of the word in both, so a word that tells nothing, however
  rare it is, has even odds, and one strong word outweighs the prior.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frequent, materialise, need

#: The limits of DNS: characters of a label, so of a word, and of a host name; longer runs of letters stay one word.
LONGEST, NAME = 63, 253
#: Rounds of learning; share of a word's frequency in both classes in its probability in either; odds before any word is seen.
ROUNDS, SHARED, PRIOR = 2, 0.2, math.log(0.1 / 0.9)
#: Rows of words or hosts up to which they are broadcast (some 100 bytes each in the JVM).
FEW = 200_000
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Words that name what training data leaves out, and words of ordinary sites. Labels that say
# nothing of a site, such as www, m, blog and example, are in neither.
BLOCK_WORDS = """
adult ads bet bets betting bonus cash casino cheap click clicks clickbait crack cracked deal deals download escort farm
fake free gambling hack jackpot keygen loan loans lottery lucky malware miracle money naked offer offers payday phishing
pharmacy pill pills poker popup porn prize promo rich seo sex slot slots spam sponsor torrent track tracker tracking
viagra warez weight win winner wins x xxx
""".split()
ALLOW_WORDS = """
about academy archive art article articles book books career city college community company contact council course
culture data department dictionary doc docs education encyclopedia event events faq food forum garden guide
health help history home hospital index institute journal kitchen lab law learn library local magazine map math
medicine museum music nature news notes online open page paper park people physics post press project public recipes
research review school science society staff story street student study support team travel tutorial university weather
web wiki world
""".split()
TOP_LEVEL = frozenset("com net org edu gov info io co uk de fr es eu".split())
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where there is no `://`."""
    form = r"(?s)^(?:(?!://).)*://([^/?#]*)([^?#]*).*$"
    fits = F.coalesce(url.contains("://"), F.lit(False))
    host = F.when(fits, F.regexp_extract(url, form, 1)).otherwise("")
    path = F.when(fits, F.regexp_extract(url, form, 2)).otherwise("")
    return F.translate(host, CAPITALS, SMALL), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def best_split(run: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely split of a run of letters into known words; unknown ones cost by their length, ties go to the longer first word."""
    if len(run) > NAME:
        return [run]
    costs = {w: -math.log(n / total) for w, n in counts.items()}
    unknown = math.log(10 * total)
    best, back = [0.0], [0]
    for end in range(1, len(run) + 1):
        choices = []
        for start in range(end):
            word = run[start:end]
            choices.append((best[start] + (costs[word] if word in costs else unknown + 2.5 * len(word)), start))
        least, start = min(choices)
        best.append(least)
        back.append(start)
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def _substrings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for run in batch["run"]:
            words = sorted({run[a:b] for a in range(len(run)) for b in range(a + 1, min(len(run), a + LONGEST) + 1)})
            yield pd.DataFrame({"run": run, "word": words})


def _splits(total: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [best_split(r, {k["word"]: k["n"] for k in known} if known is not None else {}, total) for r, known in zip(batch["run"], batch["known"], strict=True)]
            yield pd.DataFrame({"run": batch["run"], "words": words})

    return run


def _runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([a-z]+)"))


def _seeds(spark) -> DataFrame:
    return spark.createDataFrame([(w, k) for k, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)) for w in words], "word string, block int")


def split_hosts(hosts: DataFrame, path_words: DataFrame) -> DataFrame:
    """host and its words in order, for different hosts; path_words (host, word) are the different words of each host's paths."""
    spark = hosts.sparkSession
    name = F.regexp_replace(F.split("host", ":")[0], rf"(\.({'|'.join(sorted(TOP_LEVEL))}))+$", "")
    names = hosts.select("host", name.alias("name"))
    alone = names.select("host", F.explode(F.regexp_extract_all("name", F.lit("((?<=-)[a-z]+|[a-z]+(?=-))"))).alias("word")).distinct()
    known = path_words.unionByName(alone).groupBy("word").agg(F.count("*").alias("n"))
    known = known.unionByName(_seeds(spark).select("word", F.lit(1).cast("long").alias("n"))).groupBy("word").agg(F.sum("n").alias("n"))
    known = materialise(known.where(F.length("word") <= LONGEST))
    total = known.agg(F.sum("n")).first()[0]
    runs = names.select("host", F.posexplode(_runs(F.col("name"))).alias("at", "run"))
    different = materialise(runs.select("run").distinct())
    found = different.where(F.length("run") <= NAME).mapInPandas(_substrings, "run string, word string").join(known, "word")
    found = found.groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))  # a run's own substrings: NAME * LONGEST at most
    split = different.join(found, "run", "left").mapInPandas(_splits(total), "run string, words array<string>")
    words = runs.join(split, "run").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("parts"))
    return hosts.join(words, "host", "left").select("host", F.coalesce(F.flatten("parts.words"), F.array().cast("array<string>")).alias("words"))


def word_odds(host_words: DataFrame, path_words: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """word, n and odds: log odds of block to allow, learnt from different hosts (host, words) and their paths' words."""
    spark = host_words.sparkSession
    seeds = materialise(_seeds(spark))
    named = host_words.select("host", F.explode(F.array_distinct("words")).alias("word"))
    tokens = materialise(named.unionByName(path_words).distinct())
    marks = named.join(F.broadcast(seeds), "word").groupBy("host").agg(F.sum(2 * F.col("block") - 1).alias("mark")).where("mark <> 0")
    marks = materialise(marks.select("host", (F.col("mark") > 0).cast("double").alias("fixed")))
    odds = None
    for _ in range(rounds + 1):
        p = tokens.select("host").distinct().join(marks, "host", "left").withColumn("p", F.lit(math.exp(PRIOR) / (1 + math.exp(PRIOR))))
        if odds is not None:
            z = tokens.join(odds.select("word", "odds"), "word").groupBy("host").agg((F.sum("odds") + PRIOR).alias("z"))
            p = p.join(z, "host", "left").withColumn("p", 1 / (1 + F.exp(-F.coalesce("z", F.lit(PRIOR)))))
        p = p.select("host", F.coalesce("fixed", "p").alias("p"))
        counts = tokens.join(p, "host").groupBy("word").agg(F.sum("p").alias("b"), F.sum(1 - F.col("p")).alias("a"), F.count("*").alias("n"))
        own = seeds.select("word", F.col("block").cast("double").alias("b"), (1 - F.col("block")).cast("double").alias("a"), F.lit(1).cast("long").alias("n"))
        counts = materialise(counts.unionByName(own).groupBy("word").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.sum("n").alias("n")))
        blocked, allowed, n = counts.agg(F.sum("b"), F.sum("a"), F.sum("n")).first()
        of = lambda c, size: (1 - SHARED) * F.col(c) / size + SHARED * F.col("n") / n  # noqa: E731, B023
        odds = materialise(counts.select("word", "n", F.log(of("b", blocked) / of("a", allowed)).alias("odds")))
    return odds


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, words and log odds of each row of pages (page_id, url).

    Null urls, and urls without `://`, have an empty host and path and are allowed, as no word speaks
    against them; odds of exactly 0 allow. A null page_id stays null; each repeated row has its own row in the result; an
    empty table gives an empty result; extra columns, whatever their names, are not read. Host names of over NAME
    letters in a run, which DNS doesn't allow, aren't split; paths may be of any length.
    """
    host, path = url_parts(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = need(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    parts = materialise(parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.monotonically_increasing_id().alias("rid")))
    of_path = _runs(F.lower("path"))
    path_words = materialise(parts.select("host", F.explode(F.array_distinct(of_path)).alias("word")).distinct())
    host_words = materialise(split_hosts(materialise(parts.select("host").distinct()), path_words))
    odds = word_odds(host_words, path_words)
    few = lambda table: F.broadcast(table) if table.count() <= FEW else table
    scores = host_words.select("host", F.explode("words").alias("word")).join(odds, "word").groupBy("host").agg(F.sum("odds").alias("of_host"))
    scored = materialise(host_words.join(scores, "host", "left").select("host", F.concat_ws(" ", "words").alias("words"), F.coalesce("of_host", F.lit(0.0)).alias("of_host")))
    # the most frequent words of paths meet their odds without a shuffle, so that no key of the join below is hot
    often = frequent(odds, F.col("n"), FEW)
    often = F.lit(False) if often is None else often
    paths = parts.select("rid", F.explode(of_path).alias("word"))
    light = odds.where(~often).select("word", "odds")
    sums = paths.join(F.broadcast(odds.where(often).select("word", "odds")), "word")
    if light.limit(1).count():
        sums = sums.unionByName(paths.join(F.broadcast(odds.where(often).select("word")), "word", "left_anti").join(light, "word").select("word", "rid", "odds"))
    sums = sums.groupBy("rid").agg(F.sum("odds").alias("of_path"))
    out = parts.join(sums, "rid", "left").join(few(scored), "host")
    total = F.round(F.lit(PRIOR) + F.col("of_host") + F.coalesce("of_path", F.lit(0.0)), 9)
    learnt = F.when(total > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", learnt).alias("verdict"), "words", total.alias("odds"))
