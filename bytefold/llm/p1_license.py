"""Licence of each source file and repository.

Notices, licence files and manifests are normalised (copyright lines, punctuation and spelling variants removed) and
reduced to distinct texts. Hashes of their word spans are equi-joined with hashes of templates made from the licence
table: bodies, notices, names, ids, addresses and short forms. Files without a notice inherit by directory.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import ensure_checkpoint_dir
from .common import salted_left_join, table

SOURCE_SUFFIXES = (".py", ".js", ".mjs", ".cjs", ".ts", ".java", ".cpp")
CONFLICT, UNKNOWN = "conflict", "unknown"

#: Words that must stand shortly before a name (or right after it) to make it a statement (fixed values).
CONTEXT = ("license", "licensed", "identifier", "under", "lizenz", "licence", "terms", "условиях", "按", "of", "or", "released", "distributed", "available", "offered", "unter", "sous")
AFTER = ("license", "许可证发布", "许可证")
#: Forms in which a comment states terms: a tag, a line that names a licence, placing something under a licence, terms or an
#: agreement, and forbidding to hand it on. A block with a copyright line and further words states terms, too, whatever they
#: are; mentions of licences elsewhere do not (fixed values).
TERMS = (
    r"(?im)spdx-license-identifier|^__license__"
    r"|^[^\p{L}\n]*(?:licen[cs]ed?|lizenz|licencia|licença|lisenssi|лицензия|许可证?|许可协议|ライセンス|terms)\s*(?:[-:=：]|under\b)"
    r"|\b(?:released|distributed|licensed|available|offered|provided|published|governed|supplied)\s+(?:under|by)\b[^.]{0,80}?(?:licen[cs]e|terms|agreement)"
    r"|@licen[cs]e\b|\|\s*licen[cs]e:|\bunter der\b[^.]{0,40}lizenz|sous (?:la )?licence|bajo la licencia|sob a licença|под лицензией|на условиях|按[^。]{0,60}许可|依[^。]{0,60}許可"
    r"|\b(?:do|may|must|shall) not\b[^.]{0,60}\b(?:(?:re)?distribut\w*|hand(?:ed)? on|pass(?:ed)? on|disclos\w+)"
    r"|\b(?:strictly|company) confidential\b|\bproprietary and confidential\b"
)
RESERVED = "all rights reserved|all rights not granted here are reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|todos os direitos reservados|kaikki oikeudet pidätetään|все права защищены|版权所有|保留所有权利"
COPYRIGHT = rf"""(?im)^[\s*#/!"'\ufeff]*(?:(?:copyright|©|\(c\))[\s(c)©]*)+\d{{4}}[^\n]*$|^[\s*#/!"']*(?:{RESERVED})[.。]?[ \t]*$"""
MARKS = TERMS + r"|copyright|©|\(c\)|licen[cs]e"
HASH_COMMENTS = r"""(?m)(?:^\ufeff?[ \t]*#[^\n]*\n?)++|^[ \t]*(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')|^__license__\s*=[^\n]*"""
SLASH_COMMENTS = r"""(?m)/\*[\s\S]*?\*/|(?:^\ufeff?[ \t]*//[^\n]*\n?)++"""


def normal(text: Column) -> Column:
    """Lower-case words without copyright lines, comment marks and punctuation; licence is spelt license.

    A small "mit" is German rather than a licence and is kept apart from "MIT".
    """
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, COPYRIGHT, "\n")
    t = F.regexp_replace(t, r"\bmit\b", "mit_")
    t = F.regexp_replace(F.lower(t), "licence", "license")
    t = F.regexp_replace(t, r"(?<=[a-z0-9])(?=[^\x00-\x7f])|(?<=[^\x00-\x7f])(?=[a-z0-9])", " ")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}_]+", " "))


def short_forms(license_id: str) -> list[str]:
    """Names in use for a licence id, in normal form."""
    out: list[str] = []
    if m := re.fullmatch(r"(A|L|)GPL-(\d)\.0(?:-only)?", license_id):
        family, long, v = m[1].lower() + "gpl", {"A": "affero gpl", "L": "lesser gpl", "": "gpl"}[m[1]], m[2]
        for name in {family, f"gnu {family}", f"gnu {long}", long}:
            out += [f"{name}v{v}", f"{name} v{v}", f"{name} {v}", f"{name} {v} 0", f"{name} v{v} 0", f"{name} version {v}"]
    elif m := re.fullmatch(r"(Apache|MPL)-(\d)\.0", license_id):
        for name in {"Apache": ("apache", "asl", "apache license"), "MPL": ("mpl", "mozilla public license")}[m[1]]:
            out += [f"{name} {m[2]}", f"{name} {m[2]} 0", f"{name} v{m[2]}", f"{name}v{m[2]}", f"{name} version {m[2]}", f"{name} version {m[2]} 0"]
    elif m := re.fullmatch(r"BSD-(\d)-Clause", license_id):
        word = {"2": "simplified", "3": "new"}.get(m[1], m[1])
        out += [f"{m[1]} clause bsd", f"{word} bsd", f"bsd {m[1]}", f"bsd {m[1]} clause", f"{word} bsd license", f"{m[1]} clause bsd license", f"modified bsd license" if m[1] == "3" else f"bsd {m[1]} clause"]
    elif license_id == "MIT":
        out += ["expat", "mit expat", "expat license"]
    return out


def templates(licenses: DataFrame) -> DataFrame:
    """(first, n, h, license_id, sure) of the templates: first word, number of words, hash, and whether no context is needed.

    ``licenses`` is a reference table with a row per licence.
    """
    spark = licenses.sparkSession
    texts = licenses.select("license_id", F.explode(F.array(*[F.struct(F.col(c).alias("t"), F.lit(sure).alias("sure")) for c, sure in (("license_id", False), ("full_name", False), ("notice_text", True), ("body_text", True))], F.struct(F.regexp_replace("url", "^[a-z]+://", "").alias("t"), F.lit(True).alias("sure")))).alias("x"))
    rows = texts.select("license_id", normal(F.col("x.t")).alias("t"), "x.sure")
    ids = [r[0] for r in licenses.select("license_id").distinct().collect()]  # a reference table
    short = spark.createDataFrame([(i, s, False) for i in ids if i for s in short_forms(i)] or [("", "", False)], "license_id string, t string, sure boolean")
    rows = rows.unionByName(short).where("t <> ''").dropDuplicates(["t", "license_id"])
    w = F.split("t", " ")
    rows = rows.select(w[0].alias("first"), F.size(w).alias("n"), F.xxhash64("t").alias("h"), "license_id", "sure")
    one = F.when(F.min("license_id") == F.max("license_id"), F.min("license_id")).otherwise(CONFLICT)  # a text of two licences tells neither
    return rows.groupBy("first", "n", "h").agg(one.alias("license_id"), F.max("sure").alias("sure"))


def openings(licenses: DataFrame) -> str:
    """Pattern of the first five words of the notices and bodies of the reference table; one that matches nothing if it is empty."""
    heads = licenses.select(F.explode(F.array("notice_text", "body_text")).alias("t")).select(F.array_join(F.slice(F.split(normal(F.col("t")), " "), 1, 5), " ").alias("h")).where("h like '% % %'").distinct()
    words = [r["h"].replace("license", "licen[cs]e").split(" ") for r in heads.collect()]  # two a licence
    return "(?i)(?!)" + "".join("|" + r"[^\p{L}\p{N}]+".join(w) for w in sorted(words))


def statements(texts: DataFrame, licenses: DataFrame) -> DataFrame:
    """(h_text, stated) for distinct texts (h_text, text) that state terms: a licence id, ``A OR B``, conflict, unknown, or null
    if there are no words.

    The template table has a row per template of the reference table, so it is broadcast.
    """
    tpl = templates(licenses)
    starts = tpl.groupBy("first").agg(F.sort_array(F.collect_set("n"), asc=False).alias("lengths"))
    lengths = {r["first"]: r["lengths"] for r in starts.collect()}  # as many as templates
    spark = texts.sparkSession
    if not lengths:
        lengths = {"": [1]}
    table_of = F.create_map(*[x for k, v in lengths.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    # Words of the span and three before it, one after it, travel with the hash.
    t = texts.withColumn("_w", F.split(normal(F.col("text")), " "))
    found = t.select("h_text", "_w", F.posexplode("_w").alias("_i", "_first")).withColumn("_n", F.explode(F.try_element_at(table_of, F.col("_first")))).where("_i + _n <= size(_w)")
    found = found.select("h_text", "_i", "_n", F.xxhash64(F.array_join(F.slice("_w", F.col("_i") + 1, F.col("_n")), " ")).alias("h"), F.slice("_w", F.greatest(F.col("_i") - 3, F.lit(1)), F.least(F.col("_i"), F.lit(4))).alias("_before"), F.get("_w", F.col("_i") + F.col("_n")).alias("_after"))
    hits = found.join(F.broadcast(tpl.select("h", "license_id", "sure")), "h")
    hits = hits.where(F.col("sure") | F.arrays_overlap("_before", F.array(*map(F.lit, CONTEXT))) | F.coalesce(F.col("_after").isin(*AFTER), F.lit(False)))
    per = hits.groupBy("h_text").agg(F.sort_array(F.collect_list(F.struct(F.col("_i").alias("i"), (-F.col("_n")).alias("neg"), "license_id"))).alias("hits"))
    # Longest match first, none overlapping; then runs joined by "or" are choices.
    step = lambda acc, x: F.when(x["i"] >= acc["end"], F.struct((x["i"] - x["neg"]).alias("end"), F.concat(acc["kept"], F.array(F.struct(x["i"].alias("i"), (x["i"] - x["neg"]).alias("e"), x["license_id"].alias("id")))).alias("kept"))).otherwise(acc)
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<i:int,e:int,id:string>>").alias("kept"))
    per = per.select("h_text", F.aggregate("hits", zero, step)["kept"].alias("kept"))
    all_ = t.join(per, "h_text", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<struct<i:int,e:int,id:string>>")))
    joined = lambda k, x: (F.get(all_["_w"], k["e"]) == "or") & (x["i"] - k["e"] <= 3)
    merge = lambda acc, x: F.when((F.size(acc) > 0) & joined(F.element_at(acc, -1), x), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["i"].alias("i"), x["e"].alias("e"), F.array_join(F.array_sort(F.array_distinct(F.concat(F.split(F.element_at(acc, -1)["id"], " OR "), F.array(x["id"])))), " OR ").alias("id"))))).otherwise(F.concat(acc, F.array(x)))
    all_ = all_.withColumn("_said", F.array_distinct(F.transform(F.when(F.size("kept") > 0, F.aggregate("kept", F.array().cast("array<struct<i:int,e:int,id:string>>"), merge)).otherwise(F.col("kept")), lambda k: k["id"])))
    del spark
    other = F.array_join("_w", "") != ""  # what came here states terms
    said = F.col("_said")
    return all_.select("h_text", F.when(F.size(said) == 1, said[0]).when(F.size(said) > 1, CONFLICT).when(other, UNKNOWN).alias("stated"))


def combine(stated: Column) -> Column:
    """One licence of an array of statements: the known one, conflict if they differ, unknown if none is known; null for none."""
    known = F.array_distinct(F.filter(stated, lambda x: x != UNKNOWN))
    return F.when(F.size(known) > 1, CONFLICT).when(F.size(known) == 1, known[0]).when(F.size(stated) > 0, UNKNOWN)


def licenses_of(files: DataFrame, repos: DataFrame, licenses: DataFrame) -> DataFrame:
    """(scope, scope_id, license) of every repository and every source file.

    A row with null content states nothing; rows with null path are files without repository folder. An empty table gives
    no rows. Other columns of the inputs are ignored. A file loaded twice counts once where its statement is the same.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    f = files.select("file_id", "repo_id", "content", "suffix", folder.alias("dir"), name.alias("name"))
    code = F.coalesce(F.col("suffix").isin(*SOURCE_SUFFIXES), F.lit(False))
    is_license = F.coalesce(F.col("name").rlike(r"(?i)^(licen[sc]e|copying)(\..*)?$"), F.lit(False)) & ~code  # license.py is code
    is_root = F.size(F.split("dir", "/")) == 2
    manifest = F.when(F.col("name") == "package.json", F.regexp_extract("content", r'"license"\s*:\s*(?:\{[^}]*"type"\s*:\s*)?"([^"]*)"', 1)).when(F.col("name") == "pyproject.toml", F.regexp_extract("content", r'(?m)^\s*license\s*=\s*(?:\{[^}]*text\s*=\s*)?"([^"]*)"', 1))
    blocks = F.when(F.col("suffix") == ".py", F.regexp_extract_all("content", F.lit(HASH_COMMENTS), F.lit(0))).otherwise(F.regexp_extract_all("content", F.lit(SLASH_COMMENTS), F.lit(0)))
    begins = openings(licenses)
    states = lambda b: b.rlike(TERMS) | b.rlike(begins) | (b.rlike(COPYRIGHT) & (normal(b) != ""))
    notice = F.when(F.col("content").rlike(MARKS) | F.col("content").rlike(begins), F.nullif(F.array_join(F.filter(blocks, states), "\n"), F.lit("")))
    kind = F.when(is_license, "license").when(F.col("name").isin("package.json", "pyproject.toml") & is_root, "manifest").when(code, "source")
    # A manifest states by its licence field alone, and a name there needs no context.
    text = F.when(kind == "license", F.concat(F.lit("license: "), F.col("content"))).when(kind == "manifest", F.when(manifest != "", F.concat(F.lit("license: "), manifest))).when(kind == "source", notice)
    f = f.withColumn("kind", kind).where("kind is not null").withColumn("text", text).drop("content")
    # Only the part that states something is kept, under its hash.
    f = f.withColumn("h_text", F.xxhash64(normal(F.col("text"))))
    # Five uses follow; the contents, which are most of the input, are read once.
    ensure_checkpoint_dir(files.sparkSession)
    f = f.checkpoint()
    told, silent = f.where("text is not null"), f.where("text is null").drop("text", "h_text")
    said = statements(told.groupBy("h_text").agg(F.first("text").alias("text")), licenses)
    # Most files say nothing; they need no join. What follows reads the rows six times.
    f = salted_left_join(told.drop("text"), said, "h_text", "file_id").drop("h_text").unionByName(silent.withColumn("stated", F.lit(None).cast("string"))).checkpoint()

    stated = f.where(F.col("kind").isin("license", "manifest") & F.col("stated").isNotNull())
    roots = stated.where(is_root).groupBy("dir").agg(combine(F.collect_set("stated")).alias("license"))
    repo_dirs = repos.select("repo_id", F.col("repo_name").alias("_repo"))
    root_rows = roots.select(F.substring_index("dir", "/", -1).alias("_repo"), F.col("license").alias("found"))
    per_repo = repo_dirs.join(root_rows.groupBy("_repo").agg(combine(F.collect_set("found")).alias("found")), "_repo", "left").select("repo_id", F.coalesce("found", F.lit(UNKNOWN)).alias("license"))

    nested = stated.where((F.col("kind") == "license") & ~is_root).groupBy("dir").agg(combine(F.collect_set("stated")).alias("license"))
    # Directories with files lacking a notice, each once; then the deepest licence file on the way up.
    bare = f.where("kind = 'source' and stated is null").select("file_id", "repo_id", "dir")
    dirs = bare.where("dir is not null").select(F.col("dir").alias("_dir")).distinct()
    depth = F.size(F.split("_dir", "/"))
    ups = dirs.where(depth > 2).select("_dir", F.explode(F.transform(F.sequence(F.lit(3), depth), lambda k: F.array_join(F.slice(F.split("_dir", "/"), F.lit(1), k), "/"))).alias("dir"))
    near = ups.join(nested, "dir").groupBy("_dir").agg(F.max(F.struct(F.length("dir").alias("d"), "license")).alias("m")).select(F.col("_dir").alias("dir"), F.col("m.license").alias("near"))
    got = salted_left_join(bare.withColumn("dir", F.coalesce("dir", F.lit(""))), near, "dir", "file_id")
    got = salted_left_join(got, per_repo.select("repo_id", F.col("license").alias("of_repo")).dropDuplicates(["repo_id"]), "repo_id", "file_id")
    inherited = got.select("file_id", F.when(F.col("repo_id").isNull(), UNKNOWN).otherwise(F.coalesce("near", "of_repo", F.lit(UNKNOWN))).alias("license"))
    own = f.where("kind = 'source' and stated is not null").select("file_id", F.col("stated").alias("license"))
    rows = own.unionByName(inherited).select(F.lit("file").alias("scope"), F.col("file_id").alias("scope_id"), "license")
    return rows.unionByName(per_repo.select(F.lit("repo").alias("scope"), F.col("repo_id").alias("scope_id"), "license"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return licenses_of(table(spark, sf, "corpus_file"), table(spark, sf, "code_repo"), table(spark, sf, "license_ref"))


QUERIES = {"p1_found": p1_found}
