"""Group catalogue listings that describe the same item.

1. Every title, brand and attribute list is read once: the brand under either name, the specifications in base
   units, and the words of the title that are neither.
2. The dictionary is mined from trusted listings, those that state a known brand, in its column or as a whole word of
   the title, without naming two. Codes are words with a digit, or a word and a number, of any shape, that are associated with a
   brand: found ``LEAST_LISTINGS`` times and in its listings ``LEAST_RATIO`` times as often as in those of others. Titles
   with a code show the language of the catalogue (kinds, features, selling words); names are words hardly found
   there, as a listing has one model. Brand and code, or brand and name, make a phrase.
3. An Aho-Corasick automaton finds the phrases in all titles, whoever lists them. Of those that are consistent with the listing's
   brand the longest counts, with the generation that follows it; a listing without a brand gets that of its
   phrase, if only one brand has it. A small dictionary is sent to the scan's tasks; a larger one is dealt to parts by the
   first word of its phrases, and a listing goes to the parts of its words.
4. Listings of one brand, model, generation and specification are one item. A listing that leaves out
   specifications joins the item if exactly one of its brand and model agrees with what it states.

Defined results: a listing without a brand or a model is a group of its own; null titles and
attributes state nothing; a redelivered listing counts once; several values of one dimension are kept together.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import spread, table
from ..sources.tables import cut
from .lookalikes import CYRILLIC, GREEK, HYPHENS, INVISIBLE_PATTERN

#: Most brands of the brand table; least listings of a phrase, and its rate in a brand against that of others; uses of a name beside codes, as a share
#: of what a word without regard to codes has; share of a number's uses in a brand that its first word must have;
#: listings of other brands without the phrase that are taken to exist, so that a small catalogue rejects no code for want of evidence.
MOST_BRANDS, LEAST_LISTINGS, LEAST_RATIO, COMMON_SHARE, OWN_NUMBER, BACKGROUND = 100_000, 2, 10.0, 0.3, 0.5, 1000
#: Most phrases that are sent to every task, or are in one part; listings that meet a part in one task; most characters of a phrase.
MOST_SENT, PART_ROWS, LONGEST = 100_000, 100_000, 40
# Units with their factor and dimension; generations; additions to brand names.
UNITS = [
    ("mah|毫安时|毫安", 1, "battery"), ("kw|千瓦", 1000, "power"), ("watts?|w|瓦", 1, "power"), ("ml|毫升", 1, "volume"), ("lit(?:er|re)s?|l|升", 1000, "volume"),
    ("kg|公斤|千克", 1000, "weight"), ("斤", 500, "weight"), ("cm|厘米|公分", 10, "length"), ("mm|毫米", 1, "length"), ("tb", 1024, "memory"), ("gb|G", 1, "memory"),
    ("g|克", 1, "weight"), ("m|米", 1000, "length"), ("件装?|个装?|-pack|pcs|片装?|只装?", 1, "count"),
]
GENERATIONS = "pro ?max|pro|max|plus|ultra|mini|lite|iii|ii|iv|[2-9二三四五六]代"
BRAND_ADDITIONS = ("官方旗舰店", "旗舰店", "官方", "专营店")

_HAN = "㐀-鿿"
_TWINS = str.maketrans(CYRILLIC[0] + GREEK[0] + HYPHENS[0], CYRILLIC[1] + GREEK[1] + HYPHENS[1])
_MEMORY = re.compile(r"(?<=\d)(\s?)G(?![A-Za-z])")
_SPEC = re.compile(r"(?<![\w.])(\d+(?:\.\d+)?)\s*(?:" + "|".join(f"({u})" for u, _, _ in UNITS) + r")(?!\w)|(?<![a-z0-9])x(\d+)(?![a-z0-9.])|\bpack of (\d+)")
_GENERATION = re.compile(GENERATIONS)
_WITH_GENERATION = re.compile(rf"(.*[{_HAN}]|.*\d)(?:系列)?({GENERATIONS})")
_BREAK = re.compile(r"[\s/|()\[\]【】,，、;；]+")
_KEY = re.compile(r"[:：=＝]")


def plain(text: str | None) -> str:
    """Folded text in one form; the capital G of memory sizes stays."""
    if not text:
        return ""
    s = unicodedata.normalize("NFKC", INVISIBLE_PATTERN.sub("", text)).translate(_TWINS)
    s = _MEMORY.sub("\x01", s).casefold().replace("\x01", "G")
    return re.sub(r"\s", " ", unicodedata.normalize("NFC", s))


def specifications(texts: list[str]) -> dict[str, list[float]]:
    """Values of each dimension in base units (ml, W, mm, g, GB, mAh, pieces)."""
    out: dict[str, set[float]] = {}
    for s in texts:
        for m in _SPEC.finditer(s):
            pack = m.group(len(UNITS) + 2) or m.group(len(UNITS) + 3)
            if pack:
                out.setdefault("count", set()).add(float(pack))
                continue
            for i, (_, factor, dimension) in enumerate(UNITS):
                if m.group(i + 2):
                    out.setdefault(dimension, set()).add(round(float(m.group(1)) * factor, 3))
    return {k: sorted(v) for k, v in sorted(out.items())}


def title_words(title: str) -> list[str]:
    """The words of a plain title in order, without specifications and signs; a generation is a word of its own."""
    out = []
    for w in _BREAK.split(_SPEC.sub(" | ", title)):
        w = _SIGNS.sub("", w).removesuffix("系列")
        m = _WITH_GENERATION.fullmatch(w)
        out += [m.group(1).removesuffix("系列"), m.group(2)] if m else [w] if w else []
    return out


GAP = "\x1f"
_SIGNS = re.compile(r"[^\w.+]|^\.+|\.+$|_")
_DIGITS = re.compile(r"[\d.]+")


def phrases(words: list[str], names: dict[str, int]) -> list[str]:
    """The phrases that may name a model, as words with GAP between: a word, or a word without and one with a leading digit."""
    out = []
    for i, w in enumerate(words):
        if w in names or _GENERATION.fullmatch(w) or len(w) > LONGEST:
            continue
        if len(w) > 1 and not _DIGITS.fullmatch(w):
            out.append(w)
        if i + 1 < len(words) and w.isalpha() and words[i + 1][0].isdigit() and not _GENERATION.fullmatch(words[i + 1]) and len(w + words[i + 1]) <= LONGEST:
            out.append(w + GAP + words[i + 1])
    return list(dict.fromkeys(out))


def brand_of(words: list[str], brands: dict[str, int]) -> int | None:
    for w in words:
        if w in brands:
            return brands[w]
        for addition in BRAND_ADDITIONS:
            if w.endswith(addition) and w[: -len(addition)] in brands:
                return brands[w[: -len(addition)]]
    return None


def brand_names(brands: DataFrame) -> dict[str, int]:
    rows = brands.select("brand_id", "latin_name", "zh_name").limit(MOST_BRANDS + 1).collect()
    if len(rows) > MOST_BRANDS:
        raise ValueError("the table of brands is too large to be sent to the tasks")
    return {plain(n): r.brand_id for r in rows for n in (r.latin_name, r.zh_name) if n}


READ = "listing_id long, brand_id int, trusted boolean, specs string, words array<string>, patterns array<string>"


def _arrow(schema: str) -> tuple[list[str], list[pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    columns = [c.split() for c in schema.split(", ")]
    return [c[0] for c in columns], [kinds[c[1]] for c in columns]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = _arrow(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_listings(products: DataFrame, brands: dict[str, int]) -> DataFrame:
    """What each listing states; names of brands are not among the words."""
    sent = products.sparkSession.sparkContext.broadcast(brands)

    def one(listing: int, title: str | None, brand: str | None, attributes: list | None) -> tuple:
        names = sent.value
        t = plain(title)
        values = [p[1] for a in attributes or () if a for p in [_KEY.split(plain(a), maxsplit=1)] if len(p) == 2]
        specs = specifications([t, *values])
        words = title_words(t)
        stated = brand_of([w for w in _BREAK.split(plain(brand)) if w], names)
        known = stated if stated is not None else brand_of(words, names)
        trusted = known is not None and all(names.get(w, known) == known for w in words)
        stated_specs = "|".join(f"{k}={','.join(f'{x:g}' for x in v)}" for k, v in specs.items())
        return listing, known, trusted, stated_specs, words, phrases(words, names) if trusted or known is None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([one(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)], READ)

    rows = products.select(F.col("listing_id").cast("long").alias("listing_id"), "title", "brand", "attributes").filter("listing_id IS NOT NULL")
    return spread(rows).mapInArrow(run, READ)


def mine_dictionary(read: DataFrame) -> DataFrame:
    """(brand_id, phrase, pattern): the codes and names of each brand; a pattern is a phrase as words, and a phrase may have several."""
    phrase = F.replace("pattern", F.lit(GAP), F.lit("")).alias("phrase")
    grams = read.select("listing_id", "brand_id", "trusted", F.explode("patterns").alias("pattern")).select("*", phrase, F.rlike("pattern", F.lit("[0-9]")).alias("digit"))
    uses = cut(grams.groupBy("phrase", "pattern", "digit", "brand_id").agg(F.count("*").alias("n")))  # one row per phrase, writing and brand
    known = F.col("brand_id").isNotNull()
    own = uses.filter(known).groupBy("phrase", "digit", "brand_id").agg(F.sum("n").alias("n"))
    whole = uses.groupBy("phrase").agg(F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("loose"))
    sizes = read.filter("trusted").groupBy("brand_id").agg(F.count("*").alias("brand_rows"))
    total = sizes.agg(F.sum("brand_rows").alias("rows"))  # one row
    found = own.filter("digit").join(whole, "phrase").join(sizes, "brand_id").crossJoin(F.broadcast(total))
    others = (F.col("all") - F.col("n") + 0.1) / (F.col("rows") - F.col("brand_rows") + BACKGROUND)
    linked = cut(found.filter(F.col("n") / F.col("brand_rows") >= LEAST_RATIO * others).select("brand_id", "phrase", (F.col("n") + F.col("loose")).alias("listings")))
    codes = linked.filter(F.col("listings") >= LEAST_LISTINGS).select("brand_id", "phrase")
    coded = grams.filter("digit").join(linked, ["brand_id", "phrase"], "left_semi").select("listing_id").distinct().withColumn("coded", F.lit(True))
    parted = read.join(coded, "listing_id", "left").withColumn("coded", F.coalesce("coded", F.lit(False)))
    share = parted.agg((F.count_if("coded") / F.greatest(F.count_if(~F.col("coded")), F.lit(1))).alias("usual"))  # one row
    words = parted.select("coded", F.explode(F.filter("patterns", lambda p: ~p.rlike("[0-9]"))).alias("phrase"))
    use = words.groupBy("phrase").agg(F.count_if("coded").alias("coded"), F.count_if(~F.col("coded")).alias("bare"))
    names = use.crossJoin(F.broadcast(share)).filter((F.col("bare") >= LEAST_LISTINGS) & (F.col("coded") < COMMON_SHARE * F.col("usual") * F.col("bare"))).select("phrase")
    named = own.filter("NOT digit").join(names, "phrase", "left_semi").join(whole, "phrase").filter(F.col("n") + F.col("loose") >= LEAST_LISTINGS).select("brand_id", "phrase")
    written = uses.select("phrase", "pattern").distinct()
    pairs = codes.unionByName(named).join(written, "phrase").withColumn("second", F.when(F.contains("pattern", F.lit(GAP)), F.substring_index("pattern", GAP, -1)))
    # a pair is no model where its second word is a code itself, or a number that the brand's titles mostly have after other words
    itself = codes.select("brand_id", F.col("phrase").alias("second"))
    seconds = uses.filter(known & F.contains("pattern", F.lit(GAP))).groupBy("brand_id", F.substring_index("pattern", GAP, -1).alias("second")).agg(F.sum("n").alias("pairs"))
    loose = seconds.join(own.select("brand_id", "phrase", "n").join(pairs.filter("second IS NOT NULL").select("brand_id", "phrase", "second").distinct(), ["brand_id", "phrase"]), ["brand_id", "second"])
    loose = loose.filter(F.col("n") < OWN_NUMBER * F.col("pairs")).select("brand_id", "phrase").distinct()
    return pairs.join(itself, ["brand_id", "second"], "left_anti").join(loose, ["brand_id", "phrase"], "left_anti").select("brand_id", "phrase", "pattern")


MATCHED = "listing_id long, brand_id int, model string, size int, specs string"


def automaton_of(rows: list[tuple[int, str, str]]):
    """Of (brand, phrase, pattern): the automaton of the patterns at word bounds, each with its phrase and brands."""
    import ahocorasick

    by_pattern: dict[str, tuple[str, list[int]]] = {}
    for brand, phrase, pattern in rows:
        by_pattern.setdefault(pattern, (phrase, []))[1].append(brand)
    out = ahocorasick.Automaton()
    for pattern, found in by_pattern.items():
        out.add_word(GAP + pattern + GAP, (pattern, *found))
    if len(out):
        out.make_automaton()
    return out


def longest_match(words: list[str], brand: int | None, automaton) -> tuple[int, str, int] | None:
    """(brand, model with its generation, length) by the longest phrase consistent with the brand, then the first."""
    best = None
    text = GAP + GAP.join(words) + GAP
    for end, (pattern, phrase, brands) in automaton.iter(text) if len(automaton) else ():
        if brand in brands if brand is not None else len(brands) == 1:
            if best is None or len(phrase) > len(best[1]):
                best = brands[0] if brand is None else brand, phrase, end
    if best is None:
        return None
    after = text[best[2] + 1 :].split(GAP)[:2]
    generation = ""
    if after and _GENERATION.fullmatch(after[0]):
        generation = after[0].replace(" ", "")
        if len(after) > 1 and generation == "pro" and after[1] == "max":
            generation = "promax"
    return best[0], f"{best[1]} {generation}".rstrip(), len(best[1])


def match_models(read: DataFrame, dictionary: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """(listing_id, brand_id, model, size, specs) of each listing in whose title a phrase of the dictionary is found."""
    asked = read.select("listing_id", "brand_id", "specs", "words")
    count = dictionary.count()
    if count <= most_sent:
        sent = read.sparkSession.sparkContext.broadcast([tuple(r) for r in dictionary.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = automaton_of(sent.value)
            for batch in batches:
                yield _batch(list(_matched(zip(*(c.to_pylist() for c in batch.columns), strict=True), automaton)), MATCHED)

        return asked.mapInArrow(run, MATCHED)
    parts, tasks = -(-count // most_sent), -(-read.count() // PART_ROWS)
    part = lambda word: F.pmod(F.xxhash64(word), F.lit(parts)).cast("int")
    to_parts = F.array_distinct(F.transform("words", lambda w: part(w)))
    listed = asked.withColumn("part", F.explode(to_parts)).withColumn("task", F.pmod(F.xxhash64("listing_id"), F.lit(tasks)).cast("int"))
    known = dictionary.withColumn("part", part(F.substring_index("pattern", GAP, 1))).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def meet(listings: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        automaton = automaton_of(list(zip(own.brand_id, own.phrase, own.pattern, strict=True)))
        rows = ((i, None if pd.isna(b) else int(b), s, list(w)) for i, b, s, w in zip(listings.listing_id, listings.brand_id, listings.specs, listings.words, strict=True))
        return pd.DataFrame(list(_matched(rows, automaton)), columns=[c.split()[0] for c in MATCHED.split(", ")])

    found = listed.groupBy("part", "task").cogroup(known.groupBy("part", "task")).applyInPandas(meet, MATCHED)
    best = found.groupBy("listing_id").agg(F.max_by(F.struct("brand_id", "model", "size", "specs"), F.struct("size", "model")).alias("best"))
    return best.select("listing_id", "best.*")


def _matched(rows, automaton) -> Iterator[tuple]:
    for listing, brand, specs, words in rows:
        found = longest_match(words, brand, automaton)
        if found:
            yield listing, found[0], found[1], found[2], specs


def items(products: DataFrame, brands: DataFrame) -> DataFrame:
    """(listing_id, brand_id, model, specs): the item that each listing describes."""
    names = brand_names(brands)
    read = cut(read_listings(products, names).dropDuplicates(["listing_id"]))
    stated = cut(match_models(read, cut(mine_dictionary(read))).drop("size"))
    model = ["brand_id", "model"]
    variants = stated.groupBy(*model, "specs").agg(F.count("*").alias("n")).withColumn("dims", F.filter(F.split("specs", r"\|"), lambda x: x != ""))
    # the distinct variants of a model are few; a variant that states less joins the only one that it agrees with
    most = variants.groupBy(*model).agg(F.max(F.size("dims")).alias("most"))
    ranked = variants.join(most, model)
    short = ranked.filter("size(dims) < most").select(*model, "specs", "dims")
    full = ranked.filter("size(dims) = most").select(*model, F.col("specs").alias("whole"), F.col("dims").alias("whole_dims"))
    agrees = short.join(full, model).filter(F.size(F.array_except("dims", "whole_dims")) == 0)
    only = agrees.groupBy(*model, "specs").agg(F.count("*").alias("n"), F.min("whole").alias("whole")).filter("n = 1").drop("n")
    return stated.join(only, [*model, "specs"], "left").select("listing_id", *model, F.coalesce("whole", "specs").alias("specs"))


def _items(spark, sf_dir: str) -> DataFrame:
    return items(table(spark, sf_dir, "products", "listing_id", "title", "brand", "attributes"), table(spark, sf_dir, "brands"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    """All pairs of listings of one item, as asked; only rows of items with several listings are paired."""
    key = F.xxhash64("brand_id", "model", "specs")
    found = cut(_items(spark, sf_dir).withColumn("item", key))
    several = found.groupBy("item").agg(F.count("*").alias("n")).filter("n > 1").select("item")
    rows = found.join(several, "item", "left_semi").select("item", "brand_id", "model", "specs", "listing_id")
    left = rows.withColumnRenamed("listing_id", "listing_id_a")
    right = rows.withColumnRenamed("listing_id", "listing_id_b")
    return left.join(right, ["item", "brand_id", "model", "specs"]).filter("listing_id_a < listing_id_b").select("listing_id_a", "listing_id_b")


def p6_groups(spark, sf_dir: str) -> DataFrame:
    """Each listing with its group, named by the group's smallest listing; listings without an item are their own group."""
    found = cut(_items(spark, sf_dir))
    item = ["brand_id", "model", "specs"]
    first = found.groupBy(*item).agg(F.min("listing_id").alias("group_id"), F.count("*").alias("listings"))
    everyone = table(spark, sf_dir, "products", "listing_id").distinct()
    joined = everyone.join(found.join(first, item), "listing_id", "left")
    return joined.select("listing_id", F.coalesce("group_id", "listing_id").alias("group_id"), F.coalesce("listings", F.lit(1)).alias("listings"))


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
