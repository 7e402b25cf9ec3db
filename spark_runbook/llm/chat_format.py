"""Chat records of many layouts to one template, in DataFrame operations only.

A record is a JSON text. Its fingerprint is a hash of the nested field paths in it that any layout uses, over all elements of its lists; the fingerprint selects a
declarative mapping (``LAYOUTS``) that gives canonical turns (role, text). Turns are written as ``<|turn:ROLE|>TEXT<|end|>\n``. Inside texts a
backslash is put into anything that reads like a control string of this or a common other template, and taken out again when read.
The loss mask is a run-length list over the formatted text; it covers assistant texts.

Defined results: null texts and roles are empty; turns go by turn, then role, then text; repeated rows are turns of their own; a
record of no known layout keeps null turns and isn't dropped, and so does one whose list mixes layouts (its elements haven't all the same known fields);
texts of any length are kept whole; extra fields don't change a fingerprint; an empty table gives an
empty result. A conversation is one output row by contract, so its turns meet in one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name

TURNS = "array<struct<role:string,text:string>>"

#: Declarative mappings. list: (field, role field, text field); flat: (role, field) in turn order; roles: names to canonical ones.
LAYOUTS = {
    "messages": {"list": ("messages", "role", "content")},
    "share": {"list": ("conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant"}},
    "rows": {"list": ("turns", "role", "text")},
    "prompt_response": {"flat": [("user", "prompt"), ("assistant", "response")]},
    "prompt_completion": {"flat": [("user", "prompt"), ("assistant", "completion")]},
    "system_prompt_response": {"flat": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    "instruction": {"flat": [("user", "instruction"), ("assistant", "output")]},
    "instruction_input": {"flat": [("system", "instruction"), ("user", "input"), ("assistant", "output")]},
    "question": {"flat": [("user", "question"), ("assistant", "answer")]},
}


def layout_paths(layout: dict) -> list[str]:
    if "list" in layout:
        field, role, text = layout["list"]
        return sorted([field, f"{field}[].{role}", f"{field}[].{text}"])
    return sorted(f for _, f in layout["flat"])


def _vocabulary(layouts: dict) -> list[str]:
    return sorted({p for x in layouts.values() for p in layout_paths(x)})


#: The JSON reader's own limits are set aside: a turn may be of any length.
JSON = {"maxStringLen": str(2**31 - 1), "maxNestingDepth": "100000", "maxNumLen": "1000000"}


def _top(record: Column) -> Column:
    """The record's fields; what isn't a string as its JSON text."""
    return F.from_json(record, "map<string,string>", JSON)


def _elements(value: Column) -> Column:
    """A JSON list of records as their fields."""
    return F.from_json(value, "array<map<string,string>>", JSON)


def field_paths(top: Column, layouts: dict = LAYOUTS) -> Column:
    """Sorted paths of a record's fields (``_top``) that some layout knows, to the fields of its lists' elements; "[]*" behind a list whose elements differ."""
    empty = F.array().cast("array<string>")
    vocabulary = _vocabulary(layouts)
    lists = sorted({x["list"][0] for x in layouts.values() if "list" in x})

    def below(n: str) -> Column:
        known = F.array(*(F.lit(p.split("[].")[1]) for p in vocabulary if p.startswith(f"{n}[].")))
        kinds = F.array_distinct(F.transform(F.coalesce(_elements(F.element_at(top, n)), F.array().cast("array<map<string,string>>")), lambda e: F.array_sort(F.array_intersect(F.coalesce(F.map_keys(e), empty), known))))
        return F.when(F.size(kinds) > 1, F.array(F.lit(f"{n}[]*"))).otherwise(F.transform(F.coalesce(F.get(kinds, F.lit(0)), empty), lambda k: F.concat(F.lit(f"{n}[]."), k)))

    own = F.array_intersect(F.coalesce(F.map_keys(top), empty), F.array(*(F.lit(p) for p in vocabulary if "[]" not in p)))
    return F.array_sort(F.concat(own, *(below(n) for n in lists)))


def fingerprint(record: Column, layouts: dict = LAYOUTS) -> Column:
    return F.xxhash64(F.array_join(field_paths(_top(record), layouts), "\n"))


def _expected(layout: dict) -> Column:
    return F.xxhash64(F.lit("\n".join(layout_paths(layout))))


def _role(c: Column, names: dict) -> Column:
    return reduce(lambda acc, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(acc), names.items(), c)


def _mapped(top: Column, layout: dict) -> Column:
    empty = F.lit("")
    if "list" in layout:
        field, role, text = layout["list"]
        value = lambda x, k: F.coalesce(F.element_at(x, k), empty)
        return F.transform(_elements(F.element_at(top, field)), lambda x: F.struct(_role(value(x, role), layout.get("roles", {})).alias("role"), value(x, text).alias("text"))).cast(TURNS)
    return F.array(*(F.struct(F.lit(r).alias("role"), F.coalesce(F.element_at(top, f), empty).alias("text")) for r, f in layout["flat"])).cast(TURNS)


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: dict = LAYOUTS) -> DataFrame:
    """records with fingerprint, layout and turns; layout and turns are null where no mapping has that fingerprint."""
    top = free_name(records, "__top")
    keyed = records.withColumn(top, _top(F.col(record_col))).withColumn("fingerprint", F.xxhash64(F.array_join(field_paths(F.col(top), layouts), "\n")))
    pick = lambda values: reduce(lambda acc, nv: F.when(F.col("fingerprint") == _expected(layouts[nv[0]]), nv[1]).otherwise(acc), values, F.lit(None))
    return keyed.withColumn("layout", pick([(n, F.lit(n)) for n in layouts])).withColumn("turns", pick([(n, _mapped(F.col(top), x)) for n, x in layouts.items()])).drop(top)


_CONTROL = r"(?=\||/?s>|/?INST\]|/?SYS>>)"
START, SEP, END = "<|turn:", "|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\" + _CONTROL, "$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(role, F.lit("~"), F.lit("~t")), F.lit("|"), F.lit("~p")), F.lit("<"), F.lit("~l")), F.lit("["), F.lit("~b"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(role, F.lit("~b"), F.lit("[")), F.lit("~l"), F.lit("<")), F.lit("~p"), F.lit("|")), F.lit("~t"), F.lit("~"))


def format_chat(turns_df: DataFrame, turns_col: str = "turns") -> DataFrame:
    """Adds formatted (text) and mask (array of struct(loss, n): runs of code points that cover the text in order)."""
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit(SEP))
    written = turns_df.withColumn("__w", F.transform(turns_col, lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"))))
    run = lambda loss, n: F.struct(loss.alias("loss"), n.alias("n"))
    return written.select(
        *turns_df.columns,
        F.array_join(F.transform("__w", lambda w: F.concat(w["head"], w["body"], F.lit(END))), "").alias("formatted"),
        F.flatten(F.transform("__w", lambda w: F.array(run(F.lit(False), F.length(w["head"])), run(w["loss"], F.length(w["body"])), run(F.lit(False), F.lit(len(END)))))).alias("mask"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """Reads formatted and mask back: adds back (array of struct(role, text, loss)), texts unescaped, loss as the mask has it."""
    pieces = F.slice(F.split("formatted", r"<\|turn:"), 2, 1 << 30)
    role = lambda p: F.substring_index(p, SEP, 1)
    body = lambda p: F.substring(p, F.length(role(p)) + len(SEP) + 1, F.length(p) - F.length(role(p)) - len(SEP) - len(END))
    return formatted.withColumn(
        "back",
        F.transform(pieces, lambda p, i: F.struct(unescape_role(role(p)).alias("role"), unescape(body(p)).alias("text"), F.get(F.col("mask"), i * 3 + 1)["loss"].alias("loss"))),
    )


def records_of(rows: DataFrame) -> DataFrame:
    """Rows by turn to one JSON record a conversation, in the layout that its turns fit."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: F.regexp_replace(x["role"], ",", ";")), ",")
    text = lambda i: F.get(F.col("t"), i)["text"]
    to_share = lambda x: F.struct(_role(x["role"], {"user": "human", "assistant": "gpt"}).alias("from"), x["text"].alias("value"))
    plain = ~F.exists("t", lambda x: x["role"].isin("human", "gpt"))
    record = (
        F.when(roles == "user,assistant", F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(roles == "system,user,assistant", F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))))
        .when(plain & (F.col("conv_id") % 2 == 0), F.to_json(F.struct(F.transform("t", to_share).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
    )
    return conv.select("conv_id", record.alias("record"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    back = read_chat(format_chat(canonical_turns(records_of(rows.unionByName(own)))))
    loss = F.array_join(F.transform(F.filter("back", lambda t: t["loss"]), lambda t: t["text"]), "")
    digest = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(replace(replace(replace(replace(role, '~', '~t'), '|', '~p'), '<', '~l'), '[', '~b')) AS role_chars,
      length(regexp_replace(regexp_replace(text, '([<\[]\\*)(\||/?s>|/?INST\]|/?SYS>>)', '\1\\\2', 'g'), '$^', '')) AS text_chars FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(role_chars + text_chars + 17) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
