"""Conversations: cleaning, rendering, parsing of model replies, checks of tool calls.

A conversation is an array of (role, content) in the order of its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# The roles of a conversation, and the marks of the light chat format.
ROLES = ("system", "user", "assistant", "tool")
END = "<|end|>"
MESSAGES = "array<struct<role:string,content:string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, messages: from rows of (conv_id, turn, role, text)."""
    got = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return got.select("conv_id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def clean(messages: Column) -> Column:
    """Contents stripped (null counts as empty); messages of other roles and empty ones are gone."""
    stripped = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), strip(F.coalesce(m["content"], F.lit(""))).alias("content")))
    return F.filter(stripped, lambda m: m["role"].isin(*ROLES) & (m["content"] != ""))


def rendered(messages: Column, template: str = "<|im_start|>{role}\n{content}<|im_end|>\n") -> Column:
    """Clean messages in a template with {role} and {content}; '' if none are left."""
    a, rest = template.split("{role}")
    b, c = rest.split("{content}")
    return F.array_join(F.transform(clean(messages), lambda m: F.concat(F.lit(a), m["role"], F.lit(b), m["content"], F.lit(c))), "")


def chat_lite(messages: Column) -> Column:
    """The light format: system, user and assistant turns with their marks, one below the other; others vanish."""
    kept = F.filter(clean(messages), lambda m: m["role"] != "tool")
    return F.array_join(F.transform(kept, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.when(m["role"] == "assistant", END).otherwise(""))), "\n")


def instruction_messages(instruction: Column, context: Column, response: Column) -> Column:
    """A user and an assistant turn, the context behind the instruction; null if instruction or response is empty."""
    i, c, r = (strip(F.coalesce(x, F.lit(""))) for x in (instruction, context, response))
    user = F.when(c != "", F.concat(i, F.lit("\n\n"), c)).otherwise(i)
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.when((i != "") & (r != ""), F.array(turn("user", user), turn("assistant", r)))


def first_user(messages: Column) -> Column:
    """Content of the first user turn as it is; '' without one."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(1))["content"], F.lit(""))


def _object(reply: Column, fences: bool) -> Column:
    """From the first opening brace to the last closing one; null if there is no such part."""
    s = strip(reply)
    if fences:  # of a fenced reply only what stands up to the next fence
        s = F.when(s.startswith("```") & F.contains(F.substring(s, 4, 2**31 - 1), F.lit("```")), F.try_element_at(F.split(s, "```", 3), F.lit(2))).otherwise(s)
    i, j = F.instr(s, "{"), F.length(s) - F.instr(F.reverse(s), "}") + 1
    return F.when((i > 0) & F.contains(s, F.lit("}")) & (j > i), s.substr(i, j - i + 1))


def _json(text: Column) -> Column:
    """A JSON text as a variant; null if it doesn't parse or more stands behind it, which the brackets bring to light."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def parsed(reply: Column, fences: bool = True) -> Column:
    """The messages of a model's reply, stripped and without empty ones; null unless it is an object with two or more
    messages of known roles and text contents, of which an assistant's is left."""
    msgs = F.try_variant_get(_json(_object(reply, fences)), "$.messages", "array<variant>")
    role = lambda m: F.try_variant_get(m, "$.role", "string")
    content = lambda m: F.try_variant_get(m, "$.content", "variant")
    fine = F.forall(msgs, lambda m: F.coalesce(role(m).isin(*ROLES), F.lit(False)) & _is(content(m), "STRING"))
    out = F.transform(msgs, lambda m: F.struct(role(m).alias("role"), strip(F.try_variant_get(m, "$.content", "string")).alias("content")))
    out = F.filter(out, lambda m: m["content"] != "")
    return F.when((F.size(msgs) >= 2) & fine & F.exists(out, lambda m: m["role"] == "assistant"), out)


def tool_calls_valid(messages: Column) -> Column:
    """Whether a call in the assistant's turns is well formed and none of the first calls of a turn fails to parse."""
    calls = F.filter(messages, lambda m: (m["role"] == "assistant") & F.contains(m["content"], F.lit("<tool_call>")))
    inner = F.transform(calls, lambda m: strip(F.element_at(F.split(F.element_at(F.split(m["content"], "<tool_call>", 2), 2), "</tool_call>", 2), 1)))
    broken = F.exists(inner, lambda t: _json(t).isNull())
    good = F.exists(inner, lambda t: F.try_variant_get(_json(t), "$.name", "variant").isNotNull() & _is(F.try_variant_get(_json(t), "$.arguments", "variant"), "OBJECT"))
    return F.coalesce(good & ~broken, F.lit(False))


def accepted(category: Column, messages: Column) -> Column:
    """Only tool categories need valid calls; a null conversation is never accepted."""
    return messages.isNotNull() & (~category.startswith("tool") | tool_calls_valid(messages))


#: How a source's rows become text, by the kind of the source; more can be registered.
SERIALIZERS = {
    "text": lambda row: F.when(F.col(row["field"]) != "", F.col(row["field"])),
    "chat_instruction": lambda row: F.nullif(rendered(instruction_messages(F.col("instruction"), F.col("context"), F.col("response"))), F.lit("")),
    "chat_messages": lambda row: F.nullif(rendered(F.col("messages")), F.lit("")),
}
