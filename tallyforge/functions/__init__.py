"""Column expressions: text, money, order and date derivations."""

from tallyforge.functions.derive import *  # noqa: F403
