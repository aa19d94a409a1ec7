"""Files that a conversation's source names: the active branch, references, and what visible evidence says of them.

`messages` has conv_id, seq, message_id, role, parts (array of strings), attachments and assets
(arrays of structs id, name, mime, size, type) and citations (array of structs id, name).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, file_id_of, safe_file_name, text_or_empty, visible_name
from ..functions.urls import percent_decoded, redact_url
from ..shared import materialise
from .matching import containing

SANDBOX_LINK = r"\[([^\]]+)\]\(sandbox:\/mnt\/data\/((?:[^()]|\([^()]*\))+)\)"


def active_branch(nodes: DataFrame) -> DataFrame:
    """(conv_id, node_id, position): from current_node up the parents to the root, in reading order.

    `nodes` has conv_id, node_id, parent_id, current_node. Without a pointer that exists, all nodes by id. A node met again ends
    the walk. Of rows that repeat a node the greatest parent counts, of several pointers the greatest. Pointer doubling: at each
    step what has been reached jumps twice as far, so a chain of n nodes takes log2(n) joins on (conversation, node), whatever
    conversation holds it; no conversation is one group until its path is numbered.
    """
    every = nodes.groupBy("conv_id", "node_id").agg(F.max("parent_id").alias("parent_id"), F.max("current_node").alias("current_node"))
    every = materialise(every, "graph")
    ids = every.select("conv_id", F.col("node_id").alias("to"))
    jump = materialise(every.select("conv_id", "node_id", F.col("parent_id").alias("to")).join(ids, ["conv_id", "to"], "left_semi").select("conv_id", "node_id", "to"), "jump")
    pointed = every.groupBy("conv_id").agg(F.max("current_node").alias("to")).join(ids, ["conv_id", "to"], "left_semi")
    reached = materialise(pointed.select("conv_id", F.col("to").alias("node_id"), F.lit(0).cast("long").alias("up")), "reached")
    n, far = reached.count(), 1
    while n:
        further = reached.join(jump, ["conv_id", "node_id"]).select("conv_id", F.col("to").alias("node_id"), (F.col("up") + far).alias("up"))
        reached = materialise(reached.unionByName(further).groupBy("conv_id", "node_id").agg(F.min("up").alias("up")), "reached")
        before, n = n, reached.count()
        if n == before:
            break
        jump = materialise(jump.join(jump.select("conv_id", F.col("node_id").alias("to"), F.col("to").alias("then")), ["conv_id", "to"]).select("conv_id", "node_id", F.col("then").alias("to")), "jump")
        far *= 2
    last = F.max("up").over(Window.partitionBy("conv_id"))
    path = reached.select("conv_id", "node_id", (last - F.col("up")).alias("position"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("node_id")) - 1
    loose = every.join(reached.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", "node_id", place.cast("long").alias("position"))
    return path.unionByName(loose)


def safe_sandbox_path(path: Column) -> Column:
    path = F.regexp_replace(text_or_empty(path), "^sandbox:", "")
    return path.startswith("/mnt/data/") & ~F.exists(F.split(path, "/"), lambda x: x == "..")


def sandbox_links(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, pos, message_id, role, label, filename, sandbox_path, decoded): Markdown links to sandbox files in the texts of both sides.

    `pos` is the part in the upper 32 bits and the link's number in it in the lower ones.
    A file name that can't be decoded is kept as it is, with `decoded` false.
    """
    rows = messages.filter(F.col("role").isin("user", "assistant")).select("conv_id", "seq", "message_id", "role", F.posexplode("parts").alias("part", "text"))
    pattern = F.lit(SANDBOX_LINK)
    both = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("label"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("path"))
    rows = rows.select("*", F.posexplode(both).alias("k", "m"))
    last = F.element_at(F.split("m.path", "/"), -1)
    name = percent_decoded(last)
    return rows.select("conv_id", "seq", (F.shiftleft(F.col("part").cast("long"), 32) + F.col("k")).alias("pos"), "message_id", "role", clean_text(F.col("m.label")).alias("label"), safe_file_name(F.coalesce(name, last)).alias("filename"), F.concat(F.lit("sandbox:/mnt/data/"), "m.path").alias("sandbox_path"), name.isNotNull().alias("decoded"))


def file_refs(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, file_id, name, size, type, message_id, role, source): attachments, then assets, then citations; the first of each (file, message, type)."""

    def of(column: str, phase: int, source: str, type_: Column, name: Column, size: Column) -> DataFrame:
        rows = messages.select("conv_id", "seq", "message_id", "role", F.posexplode(column).alias("pos", "x"))
        return rows.select("conv_id", "seq", F.lit(phase).alias("phase"), "pos", file_id_of(F.col("x.id")).alias("file_id"), name.alias("name"), size.cast("long").alias("size"), type_.alias("type"), "message_id", "role", F.lit(source).alias("source"))

    name, size = F.nullif(F.col("x.name"), F.lit("")), F.col("x.size")
    parts = [
        of("attachments", 0, "message_metadata_attachment", F.lit("attachment"), name, size),
        of("assets", 1, "message_content_asset", F.coalesce(F.col("x.type"), F.lit("asset_pointer")), name, size),
        of("citations", 2, "message_metadata_citation", F.lit("citation_file"), name, F.lit(None)),
    ]
    every = reduce(DataFrame.unionByName, parts).filter("file_id IS NOT NULL")
    w = Window.partitionBy("conv_id", "file_id", F.coalesce("message_id", F.lit("")), "type").orderBy("seq", "phase", "pos")
    return every.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def file_refs_by_id(refs: DataFrame) -> DataFrame:
    """One reference per file: the first with a name, else the last."""
    order = F.struct("seq", "phase", "pos")
    row = F.struct(*[c for c in refs.columns if c not in ("conv_id", "file_id")])
    named = F.min_by(row, F.when(F.col("name").isNotNull(), order))
    # min_by ignores rows whose order is null only where another has one, so the name decides.
    got = refs.groupBy("conv_id", "file_id").agg(F.when(F.count("name") > 0, named).otherwise(F.max_by(row, order)).alias("r"))
    return got.select("conv_id", "file_id", "r.*")


def visible_evidence(files: DataFrame, media: DataFrame) -> DataFrame:
    """(conv_id, kind, key): visible names (of files, and media by alternative text or title) and file ids in addresses.

    `files` has conv_id, name, href; `media` conv_id, name, url. Nameless ones give no name.
    """
    names = files.select("conv_id", F.lit("name").alias("kind"), visible_name(F.col("name")).alias("key")).unionByName(media.select("conv_id", F.lit("name").alias("kind"), visible_name(F.col("name")).alias("key")))
    ids = files.select("conv_id", F.lit("id").alias("kind"), file_id_of(F.col("href")).alias("key")).unionByName(media.select("conv_id", F.lit("id").alias("kind"), file_id_of(F.col("url")).alias("key")))
    return names.unionByName(ids).filter("key IS NOT NULL").distinct()


def match_refs(refs: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """The references that something visible confirms, with `by`: id, name or sandbox, the first that holds. Equi joins only."""
    keyed = refs.withColumn("_name", visible_name(F.col("name")))
    ids = evidence.filter("kind = 'id'").select("conv_id", F.col("key").alias("file_id"), F.lit(True).alias("_id"))
    names = evidence.filter("kind = 'name'").select("conv_id", F.col("key").alias("_name"), F.lit(True).alias("_n"))
    boxes = links.select("conv_id", visible_name(F.col("filename")).alias("_name"), F.lit(True).alias("_s")).distinct()
    rows = keyed.join(ids, ["conv_id", "file_id"], "left").join(names, ["conv_id", "_name"], "left").join(boxes, ["conv_id", "_name"], "left")
    by = F.when(F.col("_id"), "id").when(F.col("_n"), "name").when(F.col("_s"), "sandbox")
    return rows.withColumn("by", by).filter("by IS NOT NULL").drop("_name", "_id", "_n", "_s")


def resolve_refs(matched: DataFrame, downloads: DataFrame) -> DataFrame:
    """Matched references with their download (conv_id, file_id, download_url, file_name, file_size), else resolved false and an error."""
    rows = matched.join(downloads, ["conv_id", "file_id"], "left")
    resolved = F.coalesce("download_url", F.lit("")) != ""
    return rows.withColumn("resolved", resolved).withColumn("error", F.when(~resolved, "no download for this file")).withColumn("href_for_metadata", F.when(resolved, redact_url(F.col("download_url")))).withColumn("visible_name", F.coalesce("name", "file_name", "file_id"))


def apply_refs_to_files(files: DataFrame, resolved: DataFrame, links: DataFrame, turns: DataFrame) -> DataFrame:
    """Files of turns with what was resolved: every visible file of that name is enriched; else the first turn of the link's role whose text holds its label gets a new file.

    `files`: conv_id, ordinal, name, href, kind, file_id, source. `turns`: conv_id, ordinal, role, text.
    """
    good = resolved.filter("resolved").select("conv_id", "file_id", F.col("download_url").alias("_url"), visible_name(F.col("visible_name")).alias("_key"), F.col("visible_name").alias("_vn"))
    one = good.groupBy("conv_id", "_key").agg(F.max_by(F.struct("file_id", "_url"), "file_id").alias("_g"))
    keyed = files.withColumn("_key", visible_name(F.col("name"))).join(one, ["conv_id", "_key"], "left")
    hit = F.col("_g").isNotNull()
    enriched = keyed.select("conv_id", "ordinal", "name", F.when(hit, F.col("_g._url")).otherwise(F.col("href")).alias("href"), "kind", F.when(hit, F.col("_g.file_id")).otherwise(F.col("file_id")).alias("file_id"), F.when(hit, F.concat("source", F.lit("+resolved"))).otherwise(F.col("source")).alias("source"))
    seen = files.select("conv_id", visible_name(F.col("name")).alias("_key")).distinct()
    boxes = links.select("conv_id", visible_name(F.col("filename")).alias("_key"), "role", "label", "filename").dropDuplicates(["conv_id", "_key"])
    loose = good.join(seen, ["conv_id", "_key"], "left_anti").join(boxes, ["conv_id", "_key"])
    # The labels are searched for within one conversation and role only, all of them at once.
    placed = containing(loose.select("conv_id", "role", "label", F.col("conv_id").alias("_c"), "file_id", "filename", "_url"), turns.select("conv_id", "role", "text", "ordinal"), ["conv_id", "role"], "label", "text")
    placed = placed.select(F.col("p._c").alias("conv_id"), "p.file_id", "p.filename", "p._url", "t.ordinal")
    first = placed.groupBy("conv_id", "file_id").agg(F.min_by(F.struct("ordinal", "filename", "_url"), "ordinal").alias("p"))
    added = first.select("conv_id", "p.ordinal", F.col("p.filename").alias("name"), F.col("p._url").alias("href"), F.lit("sandbox_attachment").alias("kind"), "file_id", F.lit("visible_sandbox_link+resolved").alias("source"))
    return enriched.unionByName(added)


def match_generated_links(links: DataFrame, turns: DataFrame, files: DataFrame, downloads: DataFrame) -> DataFrame:
    """Sandbox links with the one turn they belong to: by message id, else by a file of that label or name; more or none is ambiguous.

    `turns`: conv_id, turn_id, role, raw_html. `downloads`: conv_id, message_id, sandbox_path, download_url.
    """
    keyed = links.withColumn("_k", F.struct("seq", "pos"))
    of = turns.select("conv_id", "turn_id", "role", "raw_html")
    asked = keyed.select("conv_id", "role", "message_id", F.col("conv_id").alias("_c"), "_k")
    told = of.select("conv_id", "role", F.concat_ws("\0", "turn_id", "raw_html").alias("_told"), "turn_id")
    by_id = containing(asked, told, ["conv_id", "role"], "message_id", "_told").select(F.col("p._c").alias("conv_id"), "p._k", "t.turn_id")
    by_id = by_id.groupBy("conv_id", "_k").agg(F.count_distinct("turn_id").alias("_ni"), F.min("turn_id").alias("_ti"))
    named = files.join(of.select("conv_id", "turn_id", "role"), ["conv_id", "turn_id"]).select("conv_id", "role", "turn_id", F.explode(F.array_distinct(F.array(F.struct(F.lit("l").alias("w"), F.col("text").alias("v")), F.struct(F.lit("n").alias("w"), F.col("name").alias("v"))))).alias("f"))
    wanted = keyed.select("conv_id", "role", "_k", F.explode(F.array(F.struct(F.lit("l").alias("w"), F.col("label").alias("v")), F.struct(F.lit("n").alias("w"), F.col("filename").alias("v")))).alias("f"))
    by_name = wanted.join(named, ["conv_id", "role", "f"]).groupBy("conv_id", "_k").agg(F.count_distinct("turn_id").alias("_nn"), F.min("turn_id").alias("_tn"))
    rows = keyed.join(by_id, ["conv_id", "_k"], "left").join(by_name, ["conv_id", "_k"], "left")
    turn = F.when(F.col("_ni") == 1, F.col("_ti")).when(F.col("_nn") == 1, F.col("_tn"))
    rows = rows.withColumn("turn_id", turn).join(downloads, ["conv_id", "message_id", "sandbox_path"], "left")
    usable = safe_sandbox_path(F.col("sandbox_path")) & (F.coalesce("download_url", F.lit("")) != "")
    status = F.when(F.col("turn_id").isNull(), "unmatched_or_ambiguous_dom").when(usable, "download_url_resolved").otherwise("unresolved")
    return rows.select("conv_id", "seq", "pos", "label", "filename", "message_id", "sandbox_path", "turn_id", status.alias("status"), F.when(status == "download_url_resolved", redact_url(F.col("download_url"))).alias("href_for_metadata"))


def unresolved_generated(generated: DataFrame) -> DataFrame:
    return generated.groupBy("conv_id").agg(F.count_if(F.col("status") != "download_url_resolved").alias("unresolved"))


def source_layer_status(conversations: DataFrame, refs: DataFrame, matched: DataFrame, resolved: DataFrame, generated: DataFrame) -> DataFrame:
    """Per conversation (conv_id, platform, source_id, failed): counts and not_applicable, no_conversation_id, failed, partial or ok."""
    counts = [
        refs.groupBy("conv_id").agg(F.count("*").alias("references_found")), matched.groupBy("conv_id").agg(F.count("*").alias("visible_references_matched")),
        resolved.groupBy("conv_id").agg(F.count_if("resolved").alias("download_urls_resolved")), generated.groupBy("conv_id").agg(F.count("*").alias("sandbox_links_found"), F.count_if(F.col("status") != "download_url_resolved").alias("unresolved")),
    ]
    rows = reduce(lambda a, b: a.join(b, "conv_id", "left"), counts, conversations)
    names = ("references_found", "visible_references_matched", "download_urls_resolved", "sandbox_links_found", "unresolved")
    rows = rows.select(*conversations.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    status = F.when(F.col("platform") != "chatgpt", "not_applicable").when(F.col("source_id").isNull(), "no_conversation_id").when(F.col("failed"), "failed").when(F.col("unresolved") > 0, "partial").otherwise("ok")
    return rows.withColumn("status", status)
