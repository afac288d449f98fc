"""DataFrame operators grouped by family (turns, render, mix, prefs, tokens, leak, judge, metrics, boards)."""
