"""Matching of names, addresses and keys that don't agree to the letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import fold
from tallyloom.sources.staged import staged


def telling_tokens(name: Column, shorter: int = 3) -> Column:
    """The distinct folded words longer than `shorter` letters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(fold(name), F.lit("[a-z0-9]+"), 0), lambda t: F.length(t) > shorter))


#: Letters of the grams under which names are posted, and posted grams at most that are broadcast to thin the probes out.
GRAM, SMALL = 4, 200_000


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct runs of `size` letters."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def contained(texts: DataFrame, names: DataFrame, on: str, text: str, needles: str, size: int = GRAM) -> DataFrame:
    """on, text, needles of every pair with all needles (an array, each of `size` letters or more) in the text, among rows of equal
    `on`. Names are posted once, under that gram of theirs that the fewest names of the same `on` share; a text meets a name only
    if it holds this gram, and at most once, and is then looked through. Equal texts and equal names are one each. No posting list
    is longer than the names whose every gram is that common."""
    own = names.filter(F.size(needles) > 0).select(on, needles).distinct()
    spread = own.select(on, needles, F.explode(F.array_distinct(F.flatten(F.transform(needles, lambda n: grams(n, size))))).alias("_g"))
    often = spread.groupBy(on, "_g").agg(F.count(F.lit(1)).alias("_n"))
    posted = staged(spread.join(often, [on, "_g"]).groupBy(on, needles).agg(F.min(F.struct("_n", "_g"))["_g"].alias("_g")), "posted")
    probes = texts.filter(F.col(text).isNotNull()).select(on, text).distinct().select(on, text, F.explode(grams(F.col(text), size)).alias("_g"))
    keys = posted.select(on, "_g").distinct()
    if keys.limit(SMALL + 1).count() <= SMALL:
        probes = probes.join(F.broadcast(keys), [on, "_g"], "left_semi")
    return probes.join(posted, [on, "_g"]).filter(F.forall(needles, lambda n: F.contains(F.col(text), n))).select(on, text, needles)


def token_match(options: DataFrame, products: DataFrame, on: str, label: str, name: str, ident: str) -> DataFrame:
    """options with the product of the same bank all of whose telling words stand in the label; of several the one with most
    such words, then the smallest id. Options without a match keep null."""
    ready = products.select(on, F.col(ident).alias("_id"), F.array_sort(telling_tokens(F.col(name))).alias("_tokens")).filter(F.size("_tokens") > 0)
    low = options.withColumn("_low", fold(F.col(label)))
    first = ready.groupBy(on, "_tokens").agg(F.min("_id").alias("_id"))
    hits = contained(low, first, on, "_low", "_tokens").join(first, [on, "_tokens"])
    best = hits.groupBy(on, "_low").agg(F.min_by("_id", F.struct(-F.size("_tokens"), F.col("_id"))).alias("matched"))
    return low.join(best, [on, "_low"], "left").select(*options.columns, "matched")


def core_name(name: Column) -> Column:
    """A product's name as campaigns write it: folded, without stars and what stands in brackets."""
    return F.trim(F.replace(F.substring_index(fold(name), "(", 1), F.lit("*"), F.lit("")))


#: How a campaign names a product, in order of trust: fixed values.
SURE = {"title": 0.90, "slug": 0.85, "body": 0.60}


def contains_match(campaigns: DataFrame, products: DataFrame, on: str, campaign: str, product: str, title: str, address: str, body: str, name: str, slug: str, least: int = 10, window: int = 2500) -> DataFrame:
    """on, campaign, product, method, confidence, evidence: products of the same bank that a campaign names. The core of the name
    in the title, else the product's slug in the address, else the core in the first `window` letters of the body. Cores and
    slugs shorter than `least` letters name nothing. Evidence is the title, the slug, or the body around the name. Campaigns with
    equal texts are one until the last step, and so are equal products: only the result holds all pairs."""
    digest = lambda *columns: F.sha2(F.to_json(F.struct(on, *columns)), 256)
    every_c = campaigns.withColumn("_c", digest(title, address, body))
    c = every_c.select(on, "_c", F.col(title).alias("_said"), F.col(address).alias("_at"), F.col(body).alias("_raw")).distinct()
    c = staged(c.select(on, "_c", "_said", "_raw", fold(F.col("_said")).alias("_title"), fold(F.col("_at")).alias("_slug"), F.substring(fold(F.coalesce("_raw", F.lit(""))), 1, window).alias("_body")), "campaigns")
    every_p = products.withColumn("_p", digest(name, slug))
    p = every_p.select(on, "_p", F.col(name).alias("_name"), F.col(slug).alias("_own")).distinct()
    p = p.select(on, "_p", core_name(F.col("_name")).alias("_core"), fold(F.col("_own")).alias("_own")).filter(F.length("_core") >= least)
    p = staged(p.withColumns({"_n_core": F.array("_core"), "_n_slug": F.when(F.length("_own") >= least, F.array("_own")).otherwise(F.array().cast("array<string>"))}), "products")
    found = None
    for rank, (method, needle) in enumerate((("title", "_n_core"), ("slug", "_n_slug"), ("body", "_n_core"))):
        pairs = contained(c, p, on, f"_{method}", needle).join(c.select(on, "_c", f"_{method}"), [on, f"_{method}"]).join(p.select(on, "_p", needle), [on, needle])
        hits = pairs.select("_c", "_p", F.struct(F.lit(rank).alias("rank"), F.lit(method).alias("method"), F.lit(SURE[method]).alias("confidence")).alias("h"))
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("_c", "_p").agg(F.min("h").alias("h")).select("_c", "_p", "h.method", "h.confidence")
    at = F.instr("_body", F.col("_core"))
    around = F.trim(F.regexp_replace(F.substring(F.col("_raw"), F.greatest(F.lit(1), at - 40), F.length("_core") + F.least(at - 1, F.lit(40)) + 40), r"\s+", " "))
    told = best.join(c.select("_c", "_said", "_raw", "_body"), "_c").join(p.select("_p", "_core", "_own"), "_p")
    evidence = F.substring(F.when(F.col("method") == "title", F.col("_said")).when(F.col("method") == "slug", F.col("_own")).otherwise(around), 1, 300)
    kinds = told.select("_c", "_p", "method", "confidence", evidence.alias("evidence"))
    # Few rows become many in the last join, so these are dealt to all tasks, however small they are.
    dealt = kinds.join(every_c.select("_c", on, campaign), "_c").repartition(int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_p")
    return dealt.join(every_p.select("_p", product), "_p").select(on, campaign, product, "method", "confidence", "evidence")


def best_prefix(urls: DataFrame, url: str, prefixes: list[str]) -> DataFrame:
    """url and slug: of the addresses with the same last path part the one under the earliest prefix. Addresses under none
    are dropped."""
    path = F.regexp_extract(F.col(url), r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    slug = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    rank = F.coalesce(*[F.when(path.startswith(p), F.lit(i)) for i, p in enumerate(prefixes)], F.lit(len(prefixes)))
    rows = urls.select(F.col(url).alias("url"), slug.alias("slug"), rank.alias("rank")).filter((F.col("rank") < len(prefixes)) & (F.col("slug") != ""))
    return rows.groupBy("slug").agg(F.min_by("url", F.struct("rank", "url")).alias("url"))


def even(c: Column) -> Column:
    """Lower case, with one blank for any white space."""
    return F.lower(F.regexp_replace(c, r"\s+", " "))


#: Words of the runs on which long snippets and texts meet; shorter snippets meet on grams of letters.
RUN_WORDS = 5


def snippets_in(docs: DataFrame, ident: str, text: str, items: DataFrame, item: str, snippet: str) -> DataFrame:
    """item, ident of the texts that hold a snippet, in any case and with any white space. A snippet of more than RUN_WORDS words
    meets the texts with the run of words behind its first (which may be cut) and is then looked for; shorter ones meet them
    on their rarest gram of letters, of one letter for those under GRAM letters. Empty snippets stand nowhere."""
    wanted = items.select(item, even(F.col(snippet)).alias("_snippet")).filter(F.length(F.trim("_snippet")) > 0).withColumn("_words", F.split(F.trim("_snippet"), " "))
    body = docs.select(ident, even(F.col(text)).alias("_body"))
    hashed = lambda words, at: F.xxhash64(F.array_join(F.slice(words, at, F.lit(RUN_WORDS)), " "))
    long = wanted.filter(F.size("_words") > RUN_WORDS).withColumn("_key", hashed("_words", F.lit(2)))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - RUN_WORDS + 1))
    keyed = body.withColumn("_w", F.split("_body", " ")).select(ident, "_body", F.explode(F.array_distinct(F.transform(places, lambda i: hashed("_w", i)))).alias("_key"))
    out = keyed.join(long.select(item, "_snippet", "_key"), "_key").filter(F.contains("_body", "_snippet")).select(item, ident)
    few = wanted.filter(F.size("_words") <= RUN_WORDS).withColumns({"_needles": F.array("_snippet"), "_all": F.lit(0)})
    for size, some in ((GRAM, few.filter(F.length("_snippet") >= GRAM)), (1, few.filter(F.length("_snippet") < GRAM))):
        if not some.isEmpty():
            texts = body.withColumn("_all", F.lit(0))
            pairs = contained(texts, some, "_all", "_body", "_needles", size)
            out = out.unionByName(pairs.join(some.select(item, "_needles"), "_needles").join(body, "_body").select(item, ident))
    return out.distinct()


def shared_selectors(options: DataFrame, site: str, page: str, option: str, overlap: float = 0.5) -> DataFrame:
    """The rows whose page shows a set of options that belongs to the whole site: another set of the site has at least
    `overlap` of the smaller one's options, or the same set stands on several pages. Equal sets are one node. The smaller of two such
    sets has one of its rarest options in common, so only as many of them are posted as may be missing and one more; the larger
    ones come with all of theirs. A set looks for one other of either kind and stops at the first, so no pairs are kept."""
    sets = options.groupBy(site, page).agg(F.array_sort(F.collect_set(F.lower(option))).alias("_set"))
    nodes = sets.groupBy(site, "_set").agg(F.count(F.lit(1)).alias("_pages"))
    posted = staged(nodes.select(site, "_set", F.size("_set").alias("_n"), F.explode("_set").alias("_o")), "options")
    often = posted.groupBy(site, "_o").agg(F.count(F.lit(1)).alias("_f"))
    rarest = F.row_number().over(Window.partitionBy(site, "_set").orderBy("_f", "_o"))  # a set's own options
    least = F.ceil(F.col("_n") * overlap - 1e-9)
    small = staged(posted.join(often, [site, "_o"]).withColumn("_place", rarest).filter(F.col("_place") <= F.col("_n") - F.greatest(F.lit(1), least) + 1).select(site, "_set", "_n", "_o"), "options")
    other = lambda df: df.select(F.col(site).alias("_s"), F.col("_set").alias("_set2"), F.col("_n").alias("_n2"), F.col("_o").alias("_o2")).hint("merge")
    enough = F.size(F.array_intersect("_set", "_set2")) >= overlap * F.least("_n", "_n2")
    meet = (F.col(site) == F.col("_s")) & (F.col("_o") == F.col("_o2")) & (F.col("_set") != F.col("_set2"))
    near = small.join(other(posted), meet & (F.col("_n") <= F.col("_n2")) & enough, "left_semi").unionByName(posted.join(other(small), meet & (F.col("_n2") <= F.col("_n")) & enough, "left_semi"))
    whole = nodes.filter("_pages > 1").select(site, "_set").unionByName(near.select(site, "_set")).distinct()
    marked = sets.join(whole, [site, "_set"]).select(site, page)
    return options.join(marked, [site, page], "left_semi")


def without_shared_terms(products: DataFrame, site: str, low: str, high: str) -> DataFrame:
    """products with both terms null where several products of the site have the same pair: it is the site's, not theirs."""
    known = F.coalesce(low, high).isNotNull()
    n = F.count(F.when(known, 1)).over(Window.partitionBy(site, low, high))
    return products.withColumn("_n", n).withColumns({c: F.when(F.col("_n") <= 1, F.col(c)) for c in (low, high)}).drop("_n")


def reanchored(labels: DataFrame, campaigns: DataFrame, by_title: bool = False) -> DataFrame:
    """labels (bank, slug, title, ...) with campaign_id and method: by slug, else by the last part of the address, else, if
    asked for, by a title that is the bank's only one; orphans keep null."""
    ways = [
        ("slug", campaigns.select("bank", F.col("slug").alias("_k"), "campaign_id"), F.col("slug")),
        ("url", campaigns.select("bank", F.element_at(F.split(F.regexp_replace("url", r"[?#].*$|/+$", ""), "/"), -1).alias("_k"), "campaign_id"), F.col("slug")),
    ]
    if by_title:
        ways.append(("title", campaigns.select("bank", fold(F.col("title")).alias("_k"), "campaign_id"), fold(F.col("title"))))
    out = labels
    for name, keys, mine in ways:
        unique = keys.groupBy("bank", "_k").agg(F.min("campaign_id").alias(f"_{name}"), F.count(F.lit(1)).alias("_n"))
        unique = unique.filter("_n = 1") if name == "title" else unique
        out = out.withColumn("_k", mine).join(unique.drop("_n"), ["bank", "_k"], "left").drop("_k")
    found = [F.col(f"_{n}") for n, *_ in ways]
    method = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n, *_ in ways])
    return out.withColumns({"campaign_id": F.coalesce(*found), "method": method}).drop(*[f"_{n}" for n, *_ in ways])
