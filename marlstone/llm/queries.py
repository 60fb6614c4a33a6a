"""The query modules of this subpackage."""

from marlstone.llm import conversations, dedup, encode, leaks, personal, toxicity

MODULES = [dedup, personal, conversations, encode, leaks, toxicity]
