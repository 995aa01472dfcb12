"""Built-in prices in USD per million text tokens.

Fixed values: published list prices, their identifiers and dates.
"""

#: model, version, effective from (UTC date; empty: baseline), provisional, input, cached input, cache write, output,
#: the same four for long contexts, and the input tokens above which these apply.
VERSIONS = [
    ("gpt-5.6-sol", "gpt-5.6-sol-2026-07-09", "2026-07-09", False, 5, 0.5, 6.25, 30, 10, 1, 12.5, 45, 272000),
    ("gpt-5.6-terra", "gpt-5.6-terra-2026-07-09", "2026-07-09", False, 2.5, 0.25, 3.125, 15, 5, 0.5, 6.25, 22.5, 272000),
    ("gpt-5.6-terra", "gpt-5.6-terra-2026-07-30", "2026-07-30", False, 2, 0.2, 2.5, 12, 4, 0.4, 5, 18, 272000),
    ("gpt-5.6-luna", "gpt-5.6-luna-2026-07-09", "2026-07-09", False, 1, 0.1, 1.25, 6, 2, 0.2, 2.5, 9, 272000),
    ("gpt-5.6-luna", "gpt-5.6-luna-2026-07-30", "2026-07-30", False, 0.2, 0.02, 0.25, 1.2, 0.4, 0.04, 0.5, 1.8, 272000),
    ("gpt-5.5", "gpt-5.5-legacy", "", True, 5, 0.5, None, 30, 10, 1, None, 45, 272000),
    ("gpt-5.5-pro", "gpt-5.5-pro-legacy", "", True, 30, None, None, 180, 60, None, None, 270, 272000),
    ("gpt-5.4", "gpt-5.4-legacy", "", True, 2.5, 0.25, None, 15, 5, 0.5, None, 22.5, 272000),
    ("gpt-5.4-mini", "gpt-5.4-mini-legacy", "", True, 0.75, 0.075, None, 4.5, None, None, None, None, None),
    ("gpt-5.4-nano", "gpt-5.4-nano-legacy", "", True, 0.2, 0.02, None, 1.25, None, None, None, None, None),
    ("gpt-5.4-pro", "gpt-5.4-pro-legacy", "", True, 30, None, None, 180, 60, None, None, 270, 272000),
    ("gpt-5.3-codex", "gpt-5.3-codex-legacy", "", True, 1.75, 0.175, None, 14, None, None, None, None, None),
    ("gpt-5.3-chat-latest", "gpt-5.3-chat-latest-legacy", "", True, 1.75, 0.175, None, 14, None, None, None, None, None),
    ("gpt-5.2", "gpt-5.2-legacy", "", True, 1.75, 0.175, None, 14, None, None, None, None, None),
    ("gpt-5.2-codex", "gpt-5.2-codex-legacy", "", True, 1.75, 0.175, None, 14, None, None, None, None, None),
    ("gpt-5.1-codex-max", "gpt-5.1-codex-max-legacy", "", True, 1.25, 0.125, None, 10, None, None, None, None, None),
    ("gpt-5.1-codex", "gpt-5.1-codex-legacy", "", True, 1.25, 0.125, None, 10, None, None, None, None, None),
    ("gpt-5-codex", "gpt-5-codex-legacy", "", True, 1.25, 0.125, None, 10, None, None, None, None, None),
    ("gpt-5.1", "gpt-5.1-legacy", "", True, 1.25, 0.125, None, 10, None, None, None, None, None),
    ("gpt-5", "gpt-5-legacy", "", True, 1.25, 0.125, None, 10, None, None, None, None, None),
    ("gpt-5-chat-latest", "gpt-5-chat-latest-legacy", "", True, 1.25, 0.125, None, 10, None, None, None, None, None),
    ("gpt-5.1-codex-mini", "gpt-5.1-codex-mini-legacy", "", True, 0.25, 0.025, None, 2, None, None, None, None, None),
    ("gpt-5-mini", "gpt-5-mini-legacy", "", True, 0.25, 0.025, None, 2, None, None, None, None, None),
    ("chat-latest", "chat-latest-legacy", "", True, 5, 0.5, None, 30, None, None, None, None, None),
    ("gpt-4o", "gpt-4o-legacy", "", True, 2.5, 1.25, None, 10, None, None, None, None, None),
    ("gpt-4o-mini", "gpt-4o-mini-legacy", "", True, 0.15, 0.075, None, 0.6, None, None, None, None, None),
    ("gpt-6-sol", "gpt-6-sol-2026-09-22", "2026-09-22", False, 2, 0.2, 2.5, 10, 4, 0.4, 5, 15, 272000),
    ("gpt-6-luna", "gpt-6-luna-2026-09-22", "2026-09-22", False, 0.1, 0.01, 0.125, 0.5, 0.2, 0.02, 0.25, 0.75, 272000),
    ("gpt-6.1-sol", "gpt-6.1-sol-2026-09-29", "2026-09-29", False, 2, 0.1, 2.5, 10, 4, 0.2, 5, 15, 272000),
    ("gpt-6.1-terra", "gpt-6.1-terra-2026-10-26", "2026-10-26", False, 1, 0.05, 1.25, 5, 2, 0.1, 2.5, 7.5, 272000),
    ("gpt-6.2-astra", "gpt-6.2-astra-2026-11-17", "2026-11-17", False, 8, 0.4, 10, 40, 16, 0.8, 20, 60, 272000),
    ("gpt-6.2-sol", "gpt-6.2-sol-2026-11-17", "2026-11-17", False, 2, 0.1, 2.5, 10, 4, 0.2, 5, 15, 272000),
    ("gpt-6-astra", "gpt-6-astra-2026-09-03", "2026-09-03", False, 10, 1, 12.5, 50, 20, 2, 25, 75, 272000),
]

ALIASES = {"gpt-5.6": "gpt-5.6-sol"}

#: assumed model, route, effective from, model, upper-bound model, label, evidence.
ROUTES = [
    ("codex-auto-review", "auto-review-gpt-5.4-2026-04-23", "2026-04-23", "gpt-5.4", "gpt-5.6-sol", "GPT-5.4 Thinking (low) launch-model reference estimate", "official-product-description"),
    ("codex-auto-review", "auto-review-gpt-5.6-luna-2026-07-30", "2026-07-30", "gpt-5.6-luna", "gpt-5.6-sol", "GPT-5.6 Luna community-announced routing reference estimate", "openai-community-announcement"),
]
