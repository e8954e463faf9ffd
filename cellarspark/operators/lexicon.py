"""The catalog's lexicon and what observed words mean in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarspark.functions import labels as L
from cellarspark.functions import text as T
from cellarspark.functions import words as W
from cellarspark.operators import fuzzy
from cellarspark.operators.signals import near_fillers
from cellarspark.plans.lineage import cut

#: of kinds that share a word the one that is worth most
KINDS = {"grape": 4, "winery": 3, "name": 2, "region": 1}
#: least similarity, lead and least length of a near word by script
NEAR = {"cyr": (0.84, 0.04, 5), "lat": (0.80, 0.05, 4)}


def build_lexicon(words: DataFrame) -> DataFrame:
    """(key, canonical, kind, alias, script) from (token, kind): words of four letters or more that are no fillers under their
    best kind, and other spellings of those among them."""
    rank = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("kind")]
    own = words.where((F.length("token") >= 4) & ~T.is_generic(F.col("token"))).groupBy(F.col("token").alias("key")).agg(F.max_by("kind", rank).alias("kind"))
    own = cut(own)
    every = {**{k: (v, "winery") for k, v in W.LATIN_WINERIES.items()}, **{k: (v, "grape") for k, v in {**W.CLIPPED_GRAPES, **W.LATIN_GRAPES}.items()}}
    spellings = own.sparkSession.createDataFrame([(k, t, kind) for k, (t, kind) in every.items()], "key string, canonical string, kind string")
    aliases = spellings.join(own.select(F.col("key").alias("canonical")), "canonical").select("key", "canonical", "kind", F.lit(True).alias("alias"))
    plain = own.join(aliases.select("key"), "key", "left_anti").select("key", F.col("key").alias("canonical"), "kind", F.lit(False).alias("alias"))
    return plain.unionByName(aliases).withColumn("script", L.word_script(F.col("key")))


def _forms(word: Column) -> Column:
    """The readings of a word in the order they are tried, each with the script of the entries it may meet."""
    v = T.votes(word)
    read = lambda form, script: F.struct(form.alias("form"), F.lit(script).alias("script"))
    repaired, latin = L.repair_reading(word), F.translate(word, W.LOOK_CYRILLIC, W.LOOK_LATIN)
    mixed = F.array(read(repaired, "cyr"), read(latin, "lat"))
    cyrillic = F.when(repaired != word, F.array(read(repaired, "cyr"), read(word, "lat"))).otherwise(F.array(read(repaired, "cyr")))
    return F.when((v["cyrillic"] > 0) & (v["latin"] > 0), mixed).when((v["latin"] == 0) | T.mostly_cyrillic(word), cyrillic).otherwise(F.array(read(word, "lat")))


def match_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, catalog, kind, score): what each distinct word of `words` (word) means.

    A reading is tried as it is, then as the clearly nearest entry of its script, then as one edit from one grape's other
    spelling (Latin) or one maker (Cyrillic); a word with one stray Latin letter also with that letter as any.  Fillers, readings
    of BRUT and gated readings mean nothing; three letters only what they are another spelling of.
    """
    entries = cut(lexicon)
    asked = words.select("word").where("word is not null and word <> ''").distinct()
    w = F.col("word")
    asked = cut(asked.where(~T.is_generic(w) & ~L.brut_misread(w) & ~w.isin(*W.NOIR_GATED)))
    short = asked.where(F.length(w) == 3).join(entries.where("alias and kind = 'grape'").withColumnRenamed("key", "word"), "word").select("word", F.lit(0).alias("o"), "canonical", "kind", F.lit(0.99).alias("score"))
    read = cut(asked.where(F.length(w) >= 4).select("word", F.posexplode(_forms(w)).alias("o", "f")).select("word", "o", "f.form", "f.script"))
    f = F.col("form")
    forms = cut(read.where(~L.brut_misread(f) & (F.length(f) >= 4) & ~T.is_generic(f)).select("form", "script").distinct())
    exact = forms.join(entries.withColumnRenamed("key", "form"), ["form", "script"]).select("form", "script", "canonical", "kind", F.when(F.col("alias"), 0.99).otherwise(1.0).alias("score"))
    left = cut(forms.join(exact, ["form", "script"], "left_anti").join(near_fillers(forms.select(f.alias("word"))).withColumnRenamed("word", "form"), "form", "left_anti"))
    found = [exact]
    for script, (least, lead, shortest) in NEAR.items():
        own = entries.where(F.col("script") == script)
        mine = left.where((F.col("script") == script) & (F.length(f) >= shortest))
        near = fuzzy.margin_match(mine, own, "form", "key", least, lead).join(own, "key").select("form", F.lit(script).alias("script"), "canonical", "kind", "score")
        near = cut(near)
        rest = mine.join(near, ["form", "script"], "left_anti").where(F.length(f) >= 5)
        kind, alias, score = ("grape", True, 0.90) if script == "lat" else ("winery", False, 0.88)
        edit = fuzzy.unique_one_edit(rest, own.where((F.col("kind") == kind) & (F.col("alias") == alias)), "form", "key", "canonical", 5)
        found += [near, edit.select("form", F.lit(script).alias("script"), "canonical", F.lit(kind).alias("kind"), F.lit(score).alias("score"))]
    looked = found[0]
    for x in found[1:]:
        looked = looked.unionByName(x)
    hits = read.join(looked, ["form", "script"]).select("word", (F.col("o") + 1).alias("o"), "canonical", "kind", "score")
    v = T.votes(w)
    stray = asked.where((F.length(w) >= 4) & (v["latin"] == 1) & (v["cyrillic"] > 0)).withColumn("read", F.regexp_replace(F.translate(w, W.LOOK_LATIN, W.LOOK_CYRILLIC), f"[{W.DISTINCT_LATIN}]", "N"))
    own = entries.where("not alias and script = 'cyr'")
    snapped = fuzzy.unique_wildcard(stray, own, "read", "key", "canonical", "N", 4).join(stray, "read").join(own.select("canonical", "kind").distinct(), "canonical").select("word", F.lit(9).alias("o"), "canonical", "kind", F.lit(0.90).alias("score"))
    every = short.unionByName(hits).unionByName(snapped)
    return every.groupBy("word").agg(F.min(F.struct("o", F.col("canonical").alias("catalog"), "kind", "score")).alias("r")).select("word", "r.catalog", "r.kind", "r.score")


def clean_texts(tokens: DataFrame, key: str, hits: DataFrame) -> DataFrame:
    """(key, cleaned, n_kept, dropped, readable) of (key, pos, word): the catalog's words of each text in order, each once, how many
    were kept and dropped, and the dropped words that can be said."""
    j = tokens.join(hits, "word", "left")
    filler = near_fillers(tokens).withColumn("filler", F.lit(True))
    j = j.join(filler, "word", "left").withColumn("said", F.when(F.col("catalog").isNull() & L.readable(F.col("word"), F.coalesce("filler", F.lit(False))), F.struct("pos", "word")))
    once = lambda c, name: F.array_distinct(F.transform(F.array_sort(F.collect_list(c)), lambda x: x[name]))
    out = j.groupBy(key).agg(once(F.when(F.col("catalog").isNotNull(), F.struct("pos", "catalog")), "catalog").alias("kept"), F.count_if(F.col("catalog").isNull()).alias("dropped"), once(F.col("said"), "word").alias("said"))
    covers = F.filter("said", lambda s: ~F.exists("kept", lambda k: F.endswith(k, s) | F.endswith(s, k)))
    out = out.withColumn("readable", F.array_join(covers, " "))
    return out.select(key, F.array_join("kept", " ").alias("cleaned"), F.size("kept").alias("n_kept"), "dropped", "readable")
