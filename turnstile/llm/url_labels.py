"""A small labelled table of urls, made by rule from a seed: ordinary sites, and sites that a corpus leaves out."""

from __future__ import annotations

import random

# Words of hosts and paths that a corpus leaves out, and of ordinary ones.
UNWANTED = ("casino", "poker", "betting", "slots", "jackpot", "roulette", "gambling", "porn", "xxx", "sexcam", "escort", "hentai", "warez",
            "crack", "keygen", "torrent", "viagra", "cialis", "pills", "payday", "quickloan", "replica", "clickfarm")
UNWANTED_PATHS = ("/play/", "/bonus/", "/join/", "/free-spins/", "/download/crack/", "/cams/", "/buy-cheap/", "/win/", "/adult/")
TOPICS = ("news", "weather", "library", "school", "garden", "music", "history", "kitchen", "museum", "science", "sports", "travel", "city",
          "bank", "forum", "health", "law", "map", "bird", "river")
PATHS = ("/en/", "/en/", "/en/", "/en/", "/en/", "/en/", "/de/", "/fr/", "/es/", "/wiki/", "/blog/", "/articles/", "/about/", "/docs/", "/2024/05/", "/products/", "/")
ZONES = ("com", "net", "org", "example.org", "example.net", "example.com", "de", "fr", "edu", "info")


def labelled_urls(n: int = 1200, seed: int = 4) -> list[tuple[str, str, float]]:
    """(host, path, block) of ``n`` urls, half of them to be blocked; zones, languages and numbers say nothing."""
    rng = random.Random(seed)

    def made_up() -> str:
        return "".join(rng.choice(("th", "er", "on", "an", "st", "in", "ble", "tion", "ou", "re", "le")) for _ in range(rng.randint(2, 4)))

    out = []
    for i in range(n):
        block = i % 2 == 1
        name = rng.choice(UNWANTED if block and rng.random() < 0.85 else (*TOPICS, made_up(), made_up()))
        host = rng.choice(("", "www.", "m.", "blog.")) + rng.choice((name, name + made_up(), made_up() + name, name + str(rng.randint(1, 99)))) + "." + rng.choice(ZONES)
        plain = rng.choice(PATHS)
        unwanted = block and (not any(w in host for w in UNWANTED) or rng.random() < 0.5)
        path = (rng.choice(("", plain.rstrip("/"))) + rng.choice(UNWANTED_PATHS) if unwanted else plain) + str(rng.randint(1, 9999)) + rng.choice(("", "/", ".html"))
        out.append((host, path, float(block)))
    return out
