"""Who wrote a user-side record, by ordered prefix rules, and how human it sounds."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinlake.functions.text import WHITE

#: How records begin that a harness wrote, and those that another agent wrote.
HARNESS_PREFIXES = [
    (r"^<(recommended_plugins|codex_internal_context|goal_context|environment_context|user_instructions|system-reminder|subagent_notification|task-notification|local-command-(stdout|stderr|caveat)|turn_aborted|user_shell_command|skill|INSTRUCTIONS)\b", "harness:envelope"),
    (r"^# AGENTS\.md instructions\b", "harness:agents-md"),
    (r"^Base directory for this skill:", "harness:skill-body"),
    (r"(?i)^(Stop|PreToolUse|PostToolUse|UserPromptSubmit|SessionStart|SubagentStop|Notification) hook (feedback|error|output)", "harness:hook"),
    (r"^Tool loaded\.\s*$", "harness:tool-loaded"),
    (r"^Caveat: The messages below were generated", "harness:caveat"),
    (r"^This session is being continued from a previous conversation", "harness:compaction"),
    (r"^Your task is to create a detailed summary of the conversation", "harness:compaction"),
    (r"^The following is the Codex agent history", "harness:inherited-history"),
    (r"^Continue from where you left off\.?\s*$", "harness:resume"),
    (r"^## Context Usage\b", "harness:command-output"),
    (r"^## Context\s*\n+- Current git status", "harness:command-expansion"),
    (r"^# Autonomous loop check\b", "harness:loop"),
    (r"^\d+ background agents? (was|were) stopped by the user", "harness:agents-stopped"),
]
AGENT_PREFIXES = [
    (r"^\[(from|task from) (parent|sibling|child|supervisor)\b[^\]]*\]", "agent:relay"),
    (r"^<(teammate-message|agent-message|fork-boilerplate)\b", "agent:teammate"),
    (r"^Another Claude session sent a message:", "agent:peer-session"),
    (r"^⏰", "agent:scheduled"),
    (r"^Review this change for security vulnerabilities\.", "agent:review-bot"),
    (r'^"?Reply with exactly\b', "agent:probe"),
]
HUMAN_PREFIXES = [
    (r"^<command-name>|^/", "human:command"),
    (r"^Implement the following plan:", "human:plan-accept"),
    (r"^\[Image[: #]|^<image name=", "human:attachment"),
]
ROLE_BRIEF = r"^\"?(<role>\s*)?You are [\w'-]+"
#: User-side records that are not the human speaking.
INJECTED = [
    r"^<(task-notification|command-message|local-command-stdout|local-command-stderr|local-command-caveat|system-reminder|environment_context|user_instructions|recommended_plugins|turn_aborted|goal_context|codex_internal_context|subagent_notification|skill)\b",
    r'^\{"agent_path":',
    r"^The following is the Codex agent history whose request action you are assessing",
    r"^## Context Usage\b",
    r"^Stop hook feedback:",
    r"^The TodoWrite tool hasn't been used recently",
    r"^# AGENTS\.md instructions\b",
    r"^Base directory for this skill:",
    r"^Caveat: The messages below were generated by the user while running local commands",
    r"^Another Claude session sent a message:",
    r"^Your claude\.ai usage limit has reset",
    r"^\[Request interrupted by user",
]
#: Where a word of ASCII letters, digits and _ begins or ends; Java's own edge takes other letters for parts of words.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: Spaces that are trimmed before a voice is judged.
SPACES = "\x20\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Openings and marks of dispatched briefs and of people.
BRIEF_VERBS = r'^"?(Read|Implement|Work|Execute|Land|Build|Fix|Review|Audit|Create|Investigate|Plan|Write|Add|Update|Run|Use|Continue|Redispatch|Verify|Port|Refactor|Migrate)' + EDGE
GREETING = r"(?iu)^(hi|hey|hello|yo|moshi|okay|ok|hmm|so|wait|lol|pls|please|can you|could you|do you|what|why|how|is|are|did|does|yes|no|nah|yeah|ehh+|oh)" + EDGE
BRIEF_PLACES = rf"(?i)docs/briefs|brief (is )?at{EDGE}|your (complete |full )?brief|execute (it|that lane|this lane)"


def author_rule(text: Column) -> Column:
    """The first rule that fits, as 'author:rule'."""
    head = F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", ""), 1, 400)
    rule = F.when(head == "", "harness:empty")
    for pattern, name in [*HARNESS_PREFIXES, *AGENT_PREFIXES]:
        rule = rule.when(head.rlike(pattern), name)
    rule = rule.when(head.rlike(ROLE_BRIEF) & (F.length(text) > 200), "agent:role-brief")
    for pattern, name in HUMAN_PREFIXES:
        rule = rule.when(head.rlike(pattern), name)
    return rule.otherwise("human:typed")


def author(rule: Column) -> Column:
    return F.substring_index(rule, ":", 1)


def human_text(prose: Column) -> Column:
    """The human's words; null for injected records. A slash command keeps its arguments."""
    text = F.btrim(prose, F.lit(WHITE))
    name = F.btrim(F.regexp_extract(text, r"<command-name>([^<]*)</command-name>", 1), F.lit(WHITE))
    args = F.btrim(F.regexp_extract(text, r"<command-args>([\s\S]*?)</command-args>", 1), F.lit(WHITE))
    slash = F.when(F.startswith(name, F.lit("/")), name).otherwise(F.concat(F.lit("/"), name))
    command = F.when((name != "") & (args != ""), F.concat_ws(" ", slash, args))
    injected = F.lit(False)
    for pattern in INJECTED:
        injected = injected | text.rlike(pattern)
    return F.when(F.startswith(text, F.lit("<command-name>")), command).when(~injected, F.nullif(text, F.lit("")))


def voice(text: Column, typos: Column | None = None, rules: Collection[str] | None = None) -> tuple[Column, Column]:
    """Scores (human, brief): how much a record sounds typed, and how much dispatched; a null text scores 0 in both.

    With ``rules`` only those of these names count.
    """
    typos = F.lit(0) if typos is None else typos
    text = F.btrim(text, F.lit(SPACES))
    head = F.substring(text, 1, 400)
    letters = F.regexp_replace(head, "[^A-Za-z]", "")
    upper = F.length(F.regexp_replace(letters, "[^A-Z]", ""))

    def points(*scored: tuple[str, Column, int]) -> Column:
        total = F.lit(0)
        for name, condition, n in scored:
            if rules is None or name in rules:
                total = total + F.when(condition, n).otherwise(0)
        return total

    def lines(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    human = points(
        ("typo", typos >= 1, 2),
        ("typos", typos >= 3, 1),
        ("capitals", (F.length(letters) >= 12) & (upper / F.greatest(F.length(letters), F.lit(1)) > 0.6), 2),
        ("lower", text.rlike("^[a-z]"), 1),
        ("greeting", text.rlike(GREETING), 1),
        ("short", F.length(text) < 280, 1),
        ("question", F.contains(text, F.lit("?")), 1),
    )
    verb = text.rlike(BRIEF_VERBS)
    # fixed values: the patterns and points of both scores
    brief = points(
        ("verb", verb, 1),
        ("lane", head.rlike(f"{EDGE}(lane|LANE){EDGE}"), 2),
        ("repository", text.rlike(EDGE + r"(Repo|Repository|Worktree|Branch|HEAD)\s*:"), 1),
        ("place", text.rlike(BRIEF_PLACES), 2),
        ("exactly", text.rlike(f"{EDGE}exactly{EDGE}") & verb, 1),
        ("lists", (lines(r"(?m)^#{1,3} ") >= 2) | (lines(r"(?m)^\s*([-*]|\d+\.) ") >= 4), 1),
        ("long", F.length(text) > 800, 1),
        ("faultless", (typos == 0) & (F.length(text) > 300), 1),
    )
    return human, brief
