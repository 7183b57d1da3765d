"""Rendering of messages into training prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import fixed
from colloquy.functions.messages import part_texts
from colloquy.functions.text import bind, column, json_one_line, py_strip, role_legacy
from colloquy.schema import PART, TOOL_CALL

_FRAGMENT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])


def render_transcript(conv: Column | str) -> Column:
    """``SPEAKER: text`` lines; NULL if some turn has no speaker or no text."""
    lines = F.transform(
        column(conv),
        lambda t: F.concat(role_legacy(t["src"]), F.lit(": "), py_strip(t["value"])),
    )
    broken = F.exists(column(conv), lambda t: t["src"].isNull() | t["value"].isNull())
    return F.when(~F.coalesce(broken, F.lit(False)), F.array_join(lines, "\n"))


def render_chat_image_first(messages: Column | str, generation: bool = False) -> Column:
    """Per message: role, image slots, video slots, then each text on a line of its own."""

    def block(m: Column) -> Column:
        def slots(kind: str, token: str) -> Column:
            return F.repeat(F.lit(token), F.size(F.filter(m["content"], lambda p: p["type"] == kind)))

        return F.concat(
            F.lit(fixed.TURN_START),
            m["role"],
            F.lit(" "),
            slots("image", fixed.IMAGE_SLOT),
            slots("video", fixed.VIDEO_SLOT),
            F.array_join(F.transform(part_texts(m["content"]), lambda x: F.concat(F.lit("\n"), x)), ""),
            F.lit(fixed.TURN_END),
        )

    return generation_suffix(F.array_join(F.transform(column(messages), block), ""), generation)


def render_chat_text(messages: Column | str, generation: bool = False) -> Column:
    """Text-only chat; a default system block leads unless the chat starts with its own."""

    def block(role: Column, text: Column) -> Column:
        return F.concat(
            F.lit(fixed.TURN_START), role, F.lit("\n"), text, F.lit(fixed.TURN_END), F.lit("\n")
        )

    m = column(messages)
    first = F.get(m, F.lit(0))["role"]
    lead = F.when(first != "system", block(F.lit("system"), F.lit(fixed.DEFAULT_SYSTEM_TEXT))).otherwise("")
    body = F.transform(m, lambda x: block(x["role"], F.array_join(part_texts(x["content"]), "")))
    return generation_suffix(F.concat(lead, F.array_join(body, "")), generation)


def render_chat_interleaved(
    messages: Column | str,
    tools: Column | str | None = None,
    add_vision_id: bool = False,
    generation: bool = False,
    with_tool_calls: bool = False,
) -> Column:
    """Chat with text and vision parts in their given order.

    ``tools`` is an array of JSON objects as one-line text (see
    ``json_one_line``). With ``with_tool_calls`` a message also has
    ``tool_calls: ARRAY<STRUCT<name, arguments>>``. An empty content array
    stands for empty string content.

    The chat becomes one flat array of fragments that is joined once, so the
    work is linear in the length of the chat; numbering only looks at the
    positions of the vision fragments.
    """
    tool_list = F.array().cast("array<string>") if tools is None else F.coalesce(
        column(tools), F.array().cast("array<string>")
    )

    def text(value: Column | str) -> Column:
        v = F.lit(value) if isinstance(value, str) else value
        return F.struct(F.lit("text").alias("kind"), v.alias("text")).cast(_FRAGMENT)

    def part(p: Column) -> Column:
        kind = (
            F.when(p["type"].isin("image", "image_url"), "image")
            .when(p["type"] == "video", "video")
            .otherwise("text")
        )
        return F.struct(kind.alias("kind"), F.coalesce(p["text"], F.lit("")).alias("text")).cast(_FRAGMENT)

    def spoken(content: Column) -> Column:
        """Only text parts of a system or assistant message are printed."""
        return F.transform(
            F.filter(content, lambda p: p["text"].isNotNull()), lambda p: text(p["text"])
        )

    def calls(m: Column) -> Column:
        if not with_tool_calls:
            return F.array().cast(T.ArrayType(_FRAGMENT))
        filled = F.coalesce(F.size(m["content"]), F.lit(0)) > 0
        return F.transform(
            F.coalesce(m["tool_calls"], F.array().cast(T.ArrayType(TOOL_CALL))),
            lambda c, j: text(
                F.concat(
                    F.when((j > 0) | filled, "\n").otherwise(""),
                    F.lit('<tool_call>\n{"name": "'),
                    F.coalesce(c["name"], F.lit("")),
                    F.lit('", "arguments": '),
                    F.coalesce(c["arguments"], F.lit("null")),
                    F.lit("}\n</tool_call>"),
                )
            ),
        )

    def render(ms: Column) -> Column:
        def message(m: Column, i: Column) -> Column:
            content = F.coalesce(m["content"], F.array().cast(T.ArrayType(PART)))
            before = F.coalesce(F.when(i > 0, F.get(ms, i - 1)["role"]), F.lit(""))
            after = F.coalesce(F.get(ms, i + 1)["role"], F.lit(""))
            head = F.array(text(F.concat(F.lit(fixed.TURN_START), m["role"], F.lit("\n"))))
            tail = F.array(text(fixed.TURN_END + "\n"))
            reply_head = F.concat(
                F.when(before != "tool", fixed.TURN_START + "user").otherwise(""),
                F.lit("\n<tool_response>\n"),
            )
            reply_tail = F.concat(
                F.lit("\n</tool_response>"),
                F.when(after != "tool", fixed.TURN_END + "\n").otherwise(""),
            )
            return (
                F.when(m["role"] == "user", F.concat(head, F.transform(content, part), tail))
                .when(m["role"] == "assistant", F.concat(head, spoken(content), calls(m), tail))
                .when(
                    m["role"] == "tool",
                    F.concat(F.array(text(reply_head)), F.transform(content, part), F.array(text(reply_tail))),
                )
                .otherwise(F.array().cast(T.ArrayType(_FRAGMENT)))
            )

        opening = F.get(ms, F.lit(0))
        own = F.when(
            opening["role"] == "system",
            F.array_join(
                F.transform(
                    F.filter(
                        F.coalesce(opening["content"], F.array().cast(T.ArrayType(PART))),
                        lambda p: p["text"].isNotNull(),
                    ),
                    lambda p: p["text"],
                ),
                "",
            ),
        )
        catalogue = F.concat(
            F.lit(fixed.TURN_START + "system\n"),
            F.coalesce(F.concat(own, F.lit("\n\n")), F.lit("")),
            F.lit(fixed.TOOLS_HEAD),
            F.array_join(F.transform(tool_list, lambda t: F.concat(F.lit("\n"), t)), ""),
            F.lit(fixed.TOOLS_TAIL + fixed.TURN_END + "\n"),
        )
        plain = F.concat(F.lit(fixed.TURN_START + "system\n"), own, F.lit(fixed.TURN_END + "\n"))
        system = F.when(F.size(tool_list) > 0, catalogue).otherwise(F.coalesce(plain, F.lit("")))
        fragments = F.flatten(F.transform(ms, message))
        return F.concat(system, bind(fragments, lambda fs: _join_fragments(fs, add_vision_id)))

    return generation_suffix(bind(column(messages), render), generation)


def _join_fragments(fragments: Column, add_vision_id: bool) -> Column:
    vision = {"image": ("Picture ", fixed.VISION_IMAGE), "video": ("Video ", fixed.VISION_VIDEO)}

    def places(kind: str) -> Column:
        marked = F.transform(fragments, lambda f, i: F.when(f["kind"] == kind, i))
        return F.filter(marked, lambda i: i.isNotNull())

    def join(ctx: Column | None) -> Column:
        def one(f: Column, i: Column) -> Column:
            out = F.when(f["kind"] == "text", f["text"])
            for kind, (label, mark) in vision.items():
                number = (
                    F.lit("")
                    if ctx is None
                    else F.concat(F.lit(label), F.array_position(ctx[kind], i).cast("string"), F.lit(": "))
                )
                out = out.when(f["kind"] == kind, F.concat(number, F.lit(mark)))
            return out

        return F.array_join(F.transform(fragments, one), "")

    if not add_vision_id:
        return join(None)
    return bind(F.struct(*[places(k).alias(k) for k in vision]), join)


def render_tools(messages: Column | str, tools: Column | str, **options) -> Column:
    """Interleaved chat with a tool catalogue, tool calls and tool responses.

    The JSON of tools and arguments is printed as its parsed value is written.
    """
    tools = F.transform(column(tools), json_one_line)
    call = lambda c: c.withField("arguments", json_one_line(c["arguments"]))
    messages = F.transform(column(messages), lambda m: m.withField("tool_calls", F.transform(m["tool_calls"], call)))
    return render_chat_interleaved(messages, tools=tools, with_tool_calls=True, **options)


def generation_suffix(col: Column | str, flag: bool = False) -> Column:
    """Open an assistant turn after the prompt; off for training data."""
    c = column(col)
    return F.concat(c, F.lit(fixed.TURN_START + "assistant\n")) if flag else c


def placeholder_count(prompt: Column | str, token: str = fixed.IMAGE_SLOT) -> Column:
    return F.regexp_count(column(prompt), F.lit(re.escape(token)))
