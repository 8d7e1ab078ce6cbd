"""Line-based sources: transcripts, captured payloads, envelopes of records, bounded tails of files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loamlog.functions import prose as P
from loamlog.operators.components import checkpointed

#: Bytes read from a transcript's end, characters and items of one prose.
TAIL_BYTES, ITEM_CHARS, PROSE_CHARS, PROSE_ITEMS = 256_000, 1200, 48_000, 64
#: Who speaks, where a record's prose stands, and what parts of a list are prose.
SPEAKERS = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant"}
FIELDS = ("content", "text", "prompt", "last_prompt")
MORE_FIELDS = ("output_text", "response", "final_message", "assistant_message", "user_message", "completion")
PART_TYPES = ("text", "input_text", "output_text")
#: Keys of a captured payload, in the order in which they are looked through.
INLINE_KEYS = (
    "transcript", "transcript_text", "text", "message", "content", "body", "summary", "prompt", "user_message", "assistant_message", "final_message", "response", "output_text",
    "last_assistant_message", "completion", "result",
)
PATH_KEYS = ("transcript_path", "transcriptPath")
NEST_KEYS = ("payload", "event", "data", "message", "result", "session")
DEEPEST = 3


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TailReader(DataSourceReader):
    """A partition a file; each seeks to its last bytes, whatever the file's size."""

    def __init__(self, options: dict):
        self.paths, self.most = json.loads(options["paths"]), int(options.get("bytes", TAIL_BYTES))

    def partitions(self):
        return [FilePart(p) for p in self.paths]

    def read(self, part: FilePart):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(part.path) if "://" in part.path or part.path.startswith("file:") else (fs.LocalFileSystem(), part.path)
        with system.open_input_file(inner) as file:
            size = file.size()
            start = max(0, size - self.most)
            file.seek(start)
            data = file.read(size - start)
        if start:
            cut = data.find(b"\n")
            # the line that is cut goes; within a single line only the character that is
            data = data[cut + 1 :] if cut >= 0 else data.lstrip(bytes(range(0x80, 0xC0)))
        for place, line in enumerate(data.decode("utf-8", "replace").split("\n")):
            if line.strip():
                yield part.path, place, line.rstrip("\r")


class TailSource(DataSource):
    """``spark.read.format("tail")`` with ``paths`` (a JSON list) and ``bytes``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, place int, line string"

    def reader(self, schema) -> DataSourceReader:
        return TailReader(self.options)


def read_tails(spark: SparkSession, paths: list[str], most: int = TAIL_BYTES) -> DataFrame:
    """path, place, line: the lines within the last ``most`` bytes of each file; a line that is
    cut at the front is left out. No task reads more than that of a file."""
    spark.dataSource.register(TailSource)
    return spark.read.format("tail").option("paths", json.dumps(paths)).option("bytes", str(most)).load()


def _kind(value: Column) -> Column:
    """STRING, ARRAY, OBJECT or another type of a variant; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _text(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "string")


def _clean(strict: bool | None):
    """Prose as it stands if ``strict`` is None, else what is fit for a candidate."""
    if strict is None:
        return lambda x: F.when(P.trimmed(x) != "", P.trimmed(x))
    return lambda x: P.sanitized(x, strict)


def content_prose(content: Column, strict: bool | None) -> Column:
    """The prose of a variant: a text, or the texts of a list's parts that are prose."""
    clean, plain = _clean(strict), lambda x: P.trimmed(F.regexp_replace(x, r"(?i)</?user_query\s*>", " "))
    one = lambda i: F.when(_kind(i) == "STRING", clean(plain(_text(i)))).when(_text(i, "$.type").isin(*PART_TYPES), clean(plain(_text(i, "$.text"))))
    parts = F.filter(F.transform(F.try_variant_get(content, "$", "array<variant>"), one), lambda x: x.isNotNull())
    joined = F.when(F.size(parts) > 0, clean(F.array_join(parts, " ")))
    return F.when(_kind(content) == "STRING", clean(plain(_text(content)))).when(_kind(content) == "ARRAY", joined)


def speaker(row: Column) -> Column:
    """user or assistant by the record's type, its message's role, or its own; null else."""
    known = F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv])
    return F.coalesce(*[known[F.lower(F.coalesce(_text(row, p), F.lit("")))] for p in ("$.type", "$.message.role", "$.role")])


def parse(lines: DataFrame, strict: bool | None = None) -> DataFrame:
    """place, role, text of lines that hold prose, with the other columns of ``lines``.

    A line counts if it is a JSON object of a user or an assistant. Its prose is its message's
    content, or the first of its fields that has any. ``strict`` is as for the candidate's
    prose: True refuses what is short, structured or secret; False only noise and secrets, and
    takes more fields, and lines that are no JSON as they are (with no role); None takes all.
    """
    row = F.try_parse_json("line")
    fields = FIELDS + (MORE_FIELDS if strict is False else ())
    contents = F.array(F.when(_kind(_at(row, "$.message")) == "OBJECT", _at(row, "$.message.content")), *[_at(row, f"$.{f}") for f in fields])
    prose = F.filter(F.transform(contents, lambda c: content_prose(c, strict)), lambda x: x.isNotNull())
    said = F.when((_kind(row) == "OBJECT") & speaker(row).isNotNull(), F.get(prose, 0))
    text = F.coalesce(said, F.when(row.isNull(), P.sanitized(F.col("line"), False))) if strict is False else said
    others = [c for c in lines.columns if c not in ("place", "role", "text", "line")]
    out = lines.where(F.trim("line") != "").select("place", speaker(row).alias("role"), (F.substring(text, 1, ITEM_CHARS)).alias("text"), *others)
    return out.where("text IS NOT NULL AND text <> ''")


def joined_prose(lines: DataFrame, key: list[str]) -> DataFrame:
    """key, text: the relaxed prose of each key's lines in order. The record that makes it
    PROSE_ITEMS items is the last; a key's lines are one bounded text's."""
    items = F.sort_array(F.collect_list(F.struct("place", F.col("role").isNotNull().alias("record"), "text")))
    found = parse(lines, False).groupBy(*key).agg(items.alias("items"))
    full = F.array_min(F.filter(F.transform("items", lambda x, i: F.when(x["record"] & (i + 1 >= PROSE_ITEMS), i)), lambda i: i.isNotNull()))
    kept = F.when(full.isNull(), F.col("items")).otherwise(F.slice("items", 1, full + 1))
    return found.select(*key, F.substring(F.trim(F.array_join(F.transform(kept, lambda x: x["text"]), "\n")), 1, PROSE_CHARS).alias("text"))


def payload_prose(payloads: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """id, payload (JSON text) -> id, text: the first prose found in a captured payload.

    Objects are walked level by level, DEEPEST below the first: keys that carry prose in their
    order (a text, an object's own first prose, or a list's texts), then paths of transcripts,
    then keys that only nest. What is found first on the way is the least by the ranks of its
    keys. A text of several JSON lines is read as a transcript. ``transcripts`` (path, text)
    resolves paths. A payload that is a text is its own prose; without prose the text is empty.
    """
    whole = F.try_parse_json("payload")
    top = payloads.select("id", whole.alias("value"), F.when(whole.isNull(), P.trimmed(F.col("payload"))).when(_kind(whole) == "STRING", P.trimmed(_text(whole))).alias("own"))
    level = top.where(_kind(F.col("value")) == "OBJECT").select("id", "value", F.expr("cast(array() as array<int>)").alias("ranks"))
    keys = (*INLINE_KEYS, *PATH_KEYS, *NEST_KEYS)
    paths, nests = len(INLINE_KEYS), len(INLINE_KEYS) + len(PATH_KEYS)
    found = []
    for depth in range(DEEPEST + 1):
        members = F.array(*[F.struct(F.lit(i).alias("rank"), _at(F.col("value"), f"$.{k}").alias("value")) for i, k in enumerate(keys)])
        each = level.select("id", "ranks", F.explode(F.filter(members, lambda m: m["value"].isNotNull())).alias("m")).select("id", F.concat("ranks", F.array("m.rank")).alias("ranks"), "m.rank", F.col("m.value").alias("value"), _kind(F.col("m.value")).alias("kind"))
        item = lambda i: F.when(_kind(i) == "STRING", P.trimmed(_text(i))).otherwise(
            F.coalesce(*[F.when((_kind(_at(i, p)) == "STRING") & (P.trimmed(_text(i, p)) != ""), P.trimmed(_text(i, p))) for p in ("$.text", "$.content")])
        )
        texts = F.filter(F.transform(F.try_variant_get("value", "$", "array<variant>"), item), lambda x: x.isNotNull() & (x != ""))
        text = F.when((F.col("kind") == "STRING") & (F.col("rank") < nests), P.trimmed(_text(F.col("value")))).when(
            (F.col("kind") == "ARRAY") & (F.col("rank") < paths), F.substring(F.array_join(texts, "\n"), 1, PROSE_CHARS)
        )
        each = checkpointed(each)  # read for what it holds and for what lies below
        found.append(each.withColumn("text", text).where("text <> ''").select("id", "ranks", "text", F.col("rank").between(paths, nests - 1).alias("is_path"), (F.col("kind") == "STRING").alias("single")))
        level = each.where(F.col("kind") == "OBJECT").where(~F.col("rank").between(paths, nests - 1)).select("id", "value", "ranks")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionAll(more)
    hits = checkpointed(hits)
    shown = hits.where("NOT is_path")
    several = F.col("single") & F.contains("text", F.lit("\n")) & F.contains("text", F.lit("{")) & F.col("text").rlike('"type"\\s*:|"role"\\s*:')
    lines = shown.where(several).select("id", "ranks", F.posexplode(F.split("text", "\n+")).alias("place", "line"))
    as_lines = joined_prose(lines, ["id", "ranks"]).where("text <> ''").withColumnRenamed("text", "read")
    direct = shown.withColumn("several", several).join(as_lines, ["id", "ranks"], "left").select("id", "ranks", F.coalesce("read", "text").alias("text"))
    if transcripts is not None:
        named = hits.where("is_path").join(transcripts.select(F.col("path").alias("text"), F.col("text").alias("read")), "text")
        direct = direct.unionAll(named.where("read <> ''").select("id", "ranks", "read"))
    first = direct.groupBy("id").agg(F.min(F.struct("ranks", "text")).alias("best")).select("id", F.col("best.text").alias("first"))
    return top.join(first, "id", "left").select("id", F.coalesce("own", "first", F.lit("")).alias("text"))


def envelope_records(envelopes: DataFrame) -> DataFrame:
    """pack_id, body (base64 of one JSON record a line) -> ordinal, record, error.

    Ordinals must be 0, 1, 2, ... in line order. The first fault of an envelope is its error:
    base64, encoding, JSON or ordinal; then it has no records.
    """
    data = F.try_to_binary("body", F.lit("base64"))
    text = F.try_validate_utf8(F.try_to_binary("body", F.lit("base64")).cast("string"))
    base = envelopes.select("pack_id", data.alias("data"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    parsed = F.transform(lines, lambda x: F.from_json(x, "ordinal int, text string"))
    base = base.withColumns({"lines": lines, "rows": parsed})
    ordinals = F.transform("rows", lambda r: r["ordinal"])
    wanted = F.when(F.size("rows") > 0, F.sequence(F.lit(0), F.size("rows") - 1))
    error = (
        F.when(F.col("data").isNull(), "invalid_base64").when(F.col("text").isNull(), "invalid_encoding")
        .when(F.exists("rows", lambda r: r.isNull() | (r["ordinal"].isNull() & r["text"].isNull())), "invalid_json")
        .when(ordinals != wanted, "ordinal_mismatch")
    )
    base = base.withColumn("error", error)
    rows = F.when(F.col("error").isNull(), F.col("rows"))
    return base.select("pack_id", "error", F.explode_outer(rows).alias("r")).select("pack_id", "r.ordinal", "r.text", "error")


def redact_envelopes(envelopes: DataFrame) -> DataFrame:
    """pack_id, error, n_records, digest: envelopes after redaction.

    The first fault of the envelope itself counts, then the first record, by ordinal, that a
    policy refuses. Without any, the digest is of the records' normal forms, joined by line
    ends. Envelopes are bounded by contract, so one row holds the records of one.
    """
    rows = envelope_records(envelopes)
    coded = rows.withColumn("normal", P.nfc_lf(F.col("text")))
    coded = coded.withColumn("code", P.policy_code(F.col("normal")))
    refused = F.when(F.col("code").isNotNull(), F.struct("ordinal", "code"))
    packs = coded.groupBy("pack_id").agg(
        F.max("error").alias("fault"), F.min(refused).alias("bad"), F.sort_array(F.collect_list(F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", "normal")))).alias("parts")
    )
    error = F.coalesce("fault", F.col("bad.code"))
    joined = F.array_join(F.transform("parts", lambda p: p["normal"]), "\n")
    return packs.select("pack_id", error.alias("error"), F.when(error.isNull(), F.size("parts")).alias("n_records"), F.when(error.isNull(), F.sha2(joined, 256)).alias("digest"))


def lenient_json(text: Column, schema: str) -> Column:
    """The whole text as JSON, else its first braced block; null if neither parses."""
    block = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parsed = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema))
    return F.coalesce(parsed(text), parsed(F.when(block != "", block)))
