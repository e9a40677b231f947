"""Identifiers, prompts and chat texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The system and user texts that training and generation share, and a chat template.
SYSTEM_PROMPT = (
    "You are a clinical documentation assistant. Given a clinical note, generate a realistic doctor-patient dialogue consistent with the note. "
    "Output only the dialogue, formatted as alternating `Doctor:`/`Patient:` turns — no other text."
)
PROMPT_PREFIX = "Clinical note:\n"
TEMPLATE = ("<|im_start|>{role}\n", "{content}", "<|im_end|>\n")
#: Characters shown of a long note.
SHOWN = 1500


def note_id(text: Column) -> Column:
    """Content hash, cut to 64 bits."""
    return F.concat(F.lit("note-"), F.substring(F.sha2(text.cast("binary"), 256), 1, 16))


def user_prompt(note: Column) -> Column:
    return F.concat(F.lit(PROMPT_PREFIX), note)


def chat_messages(note: Column, target: Column, system: str = SYSTEM_PROMPT) -> Column:
    said = (("system", F.lit(system)), ("user", user_prompt(note)), ("assistant", target))
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in said])


def chat_text(messages: Column, template: tuple[str, str, str] = TEMPLATE) -> Column:
    start, body, end = template
    a, b = start.split("{role}")
    c, d = body.split("{content}")
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(a), m["role"], F.lit(b), F.lit(c), m["content"], F.lit(d), F.lit(end))), "")


def shown(text: Column, n: int = SHOWN) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(f"\n[first {n} characters]"))).otherwise(text)
