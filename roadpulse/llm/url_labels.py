"""The small labelled URL table of the URL filter.

Hosts and paths are put together by a rule from word lists: names that belong to
gambling, adult, advertising, malware and link-farm sites are ``block``, names of ordinary
sites ``allow``. Ordinary names also come as made-up words of syllables, so that a name
nobody knows is not held against a site. The table has ``ROWS`` rows of each verdict.
"""

from __future__ import annotations

import random

# Words of sites that are not wanted (fixed values).
UNWANTED = (
    "adclick adserver ads adult affiliate banner bet betting bingo bitcoin-doubler bonus "
    "botnet casino cheap-pills clickbait click-farm cracked cracks deals-now dating-hot doorway "
    "escort fake-news free-money free-prize gambling get-rich hack hot-singles jackpot keygen "
    "link-farm linkfarm loan lottery malware miracle-cure nude payday phishing pills poker "
    "popunder popup porn ringtones roulette scam sex slots spam spyware survey-reward sweepstakes "
    "torrent-free track tracker tracking viagra warez webcam-girls win xxx"
).split()
# Words of ordinary sites (fixed values).
WANTED = (
    "archive art bank blog books cat chess city climate cloud code college cooking course culture "
    "daily data design docs energy farm film forum garden gazette health history home hospital "
    "house journal kids lab language law library map market math media medicine mountain museum "
    "music nature news ocean office paper park photo physics plant press project radio recipes "
    "research river school science shop space sport state story studio teacher theatre times town "
    "travel university village weather wiki work world"
).split()
SYLLABLES = "al an ar ath be ble ca con da de den ed en er es fo ge ha he in ing ion is ka la le ly ma men mo na ne nt on or ou ra re ri ro se sh st ta te th ti tion to un ver we wh".split()
TOPS = ("com", "org", "net", "info", "io", "de", "fr", "es", "co.uk", "example.com", "example.org", "example.net")
LEADS = ("", "", "www.", "www.", "m.", "blog.")
SECTIONS = ("", "en/", "de/", "fr/", "es/", "posts/", "2023/05/", "category/", "item/", "index.html")
ROWS = 2000


def labelled(rows: int = ROWS, seed: int = 17) -> list[tuple[str, str, str]]:
    """host, path, verdict."""
    rng = random.Random(seed)
    out = []
    for k in range(2 * rows):
        block = k % 2 == 0
        own = rng.choice(UNWANTED if block else WANTED)
        other = rng.choice([*WANTED, "".join(rng.choices(SYLLABLES, k=rng.randint(2, 4)))])
        if not block and rng.random() < 0.6:
            own = "".join(rng.choices(SYLLABLES, k=rng.randint(2, 4)))
        name = rng.choice([own, f"{own}-{other}", f"{other}-{own}", f"{own}{rng.randint(1, 99)}" if block else own])
        host = f"{rng.choice(LEADS)}{name}.{rng.choice(TOPS)}"
        path = "/" + rng.choice(SECTIONS) + rng.choice(["", str(rng.randint(1, 9999)), f"{other}.html"])
        if block and rng.random() < 0.2:  # an ordinary host with an unwanted path
            host, path = f"{rng.choice(LEADS)}{other}.{rng.choice(TOPS)}", f"/{own}/{rng.randint(1, 9999)}"
        out.append((host, path, "block" if block else "allow"))
    return out
