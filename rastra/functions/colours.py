"""Built-in colour maps: their stops, and the 256 colours made of them."""

from __future__ import annotations

import math

#: Sequential maps, evenly spaced.
SEQUENTIAL = {
    "blues": "f7fbff deebf7 c6dbef 9ecae1 6baed6 4292c6 2171b5 08519c 08306b",
    "bugn": "f7fcfd e5f5f9 ccece6 99d8c9 66c2a4 41ae76 238b45 006d2c 00441b",
    "bupu": "f7fcfd e0ecf4 bfd3e6 9ebcda 8c96c6 8c6bb1 88419d 810f7c 4d004b",
    "gnbu": "f7fcf0 e0f3db ccebc5 a8ddb5 7bccc4 4eb3d3 2b8cbe 0868ac 084081",
    "greens": "f7fcf5 e5f5e0 c7e9c0 a1d99b 74c476 41ab5d 238b45 006d2c 00441b",
    "greys": "ffffff f0f0f0 d9d9d9 bdbdbd 969696 737373 525252 252525 000000",
    "oranges": "fff5eb fee6ce fdd0a2 fdae6b fd8d3c f16913 d94801 a63603 7f2704",
    "orrd": "fff7ec fee8c8 fdd49e fdbb84 fc8d59 ef6548 d7301f b30000 7f0000",
    "pubu": "fff7fb ece7f2 d0d1e6 a6bddb 74a9cf 3690c0 0570b0 045a8d 023858",
    "pubugn": "fff7fb ece2f0 d0d1e6 a6bddb 67a9cf 3690c0 02818a 016c59 014636",
    "purd": "f7f4f9 e7e1ef d4b9da c994c7 df65b0 e7298a ce1256 980043 67001f",
    "purples": "fcfbfd efedf5 dadaeb bcbddc 9e9ac8 807dba 6a51a3 54278f 3f007d",
    "rdpu": "fff7f3 fde0dd fcc5c0 fa9fb5 f768a1 dd3497 ae017e 7a0177 49006a",
    "reds": "fff5f0 fee0d2 fcbba1 fc9272 fb6a4a ef3b2c cb181d a50f15 67000d",
    "ylgn": "ffffe5 f7fcb9 d9f0a3 addd8e 78c679 41ab5d 238443 006837 004529",
    "ylgnbu": "ffffd9 edf8b1 c7e9b4 7fcdbb 41b6c4 1d91c0 225ea8 253494 081d58",
    "ylorbr": "ffffe5 fff7bc fee391 fec44f fe9929 ec7014 cc4c02 993404 662506",
    "ylorrd": "ffffcc ffeda0 fed976 feb24c fd8d3c fc4e2a e31a1c bd0026 800026",
}
#: Diverging maps and further even ones.
DIVERGING = {
    "brbg": "543005 8c510a bf812d dfc27d f6e8c3 f5f5f5 c7eae5 80cdc1 35978f 01665e 003c30",
    "piyg": "8e0152 c51b7d de77ae f1b6da fde0ef f7f7f7 e6f5d0 b8e186 7fbc41 4d9221 276419",
    "prgn": "40004b 762a83 9970ab c2a5cf e7d4e8 f7f7f7 d9f0d3 a6dba0 5aae61 1b7837 00441b",
    "puor": "7f3b08 b35806 e08214 fdb863 fee0b6 f7f7f7 d8daeb b2abd2 8073ac 542788 2d004b",
    "rdbu": "67001f b2182b d6604d f4a582 fddbc7 f7f7f7 d1e5f0 92c5de 4393c3 2166ac 053061",
    "rdgy": "67001f b2182b d6604d f4a582 fddbc7 ffffff e0e0e0 bababa 878787 4d4d4d 1a1a1a",
    "rdylbu": "a50026 d73027 f46d43 fdae61 fee090 ffffbf e0f3f8 abd9e9 74add1 4575b4 313695",
    "rdylgn": "a50026 d73027 f46d43 fdae61 fee08b ffffbf d9ef8b a6d96a 66bd63 1a9850 006837",
    "spectral": "9e0142 d53e4f f46d43 fdae61 fee08b ffffbf e6f598 abdda4 66c2a5 3288bd 5e4fa2",
    "wistia": "e4ff7a ffe81a ffbd00 ffa000 fc7f00",
}
#: Qualitative maps, each colour a band.
QUALITATIVE = {
    "accent": "7fc97f beaed4 fdc086 ffff99 386cb0 f0027f bf5b17 666666",
    "dark2": "1b9e77 d95f02 7570b3 e7298a 66a61e e6ab02 a6761d 666666",
    "paired": "a6cee3 1f78b4 b2df8a 33a02c fb9a99 e31a1c fdbf6f ff7f00 cab2d6 6a3d9a ffff99 b15928",
    "pastel1": "fbb4ae b3cde3 ccebc5 decbe4 fed9a6 ffffcc e5d8bd fddaec f2f2f2",
    "pastel2": "b3e2cd fdcdac cbd5e8 f4cae4 e6f5c9 fff2ae f1e2cc cccccc",
    "set1": "e41a1c 377eb8 4daf4a 984ea3 ff7f00 ffff33 a65628 f781bf 999999",
    "set2": "66c2a5 fc8d62 8da0cb e78ac3 a6d854 ffd92f e5c494 b3b3b3",
    "set3": "8dd3c7 ffffb3 bebada fb8072 80b1d3 fdb462 b3de69 fccde5 d9d9d9 bc80bd ccebc5 ffed6f",
    "tab10": "1f77b4 ff7f0e 2ca02c d62728 9467bd 8c564b e377c2 7f7f7f bcbd22 17becf",
    "tab20": "1f77b4 aec7e8 ff7f0e ffbb78 2ca02c 98df8a d62728 ff9896 9467bd c5b0d5 8c564b c49c94 e377c2 f7b6d2 7f7f7f c7c7c7 bcbd22 dbdb8d 17becf 9edae5",
    "tab20b": "393b79 5254a3 6b6ecf 9c9ede 637939 8ca252 b5cf6b cedb9c 8c6d31 bd9e39 e7ba52 e7cb94 843c39 ad494a d6616b e7969c 7b4173 a55194 ce6dbd de9ed6",
    "tab20c": "3182bd 6baed6 9ecae1 c6dbef e6550d fd8d3c fdae6b fdd0a2 31a354 74c476 a1d99b c7e9c0 756bb1 9e9ac8 bcbddc dadaeb 636363 969696 bdbdbd d9d9d9",
}
#: Maps by channel (red, green, blue); stops "place value", or "place before after" at a jump.
CHANNELS = {
    "gray": ["0 0, 1 1"] * 3,
    "binary": ["0 1, 1 0"] * 3,
    "bone": ["0 0, .746032 .652778, 1 1", "0 0, .365079 .319444, .746032 .777778, 1 1", "0 0, .365079 .444444, 1 1"],
    "cool": ["0 0, 1 1", "0 1, 1 0", "0 1, 1 1"],
    "copper": ["0 0, .809524 1, 1 1", "0 0, 1 .7812", "0 0, 1 .4975"],
    "hot": ["0 .0416, .365079 1, 1 1", "0 0, .365079 0, .746032 1, 1 1", "0 0, .746032 0, 1 1"],
    "hsv": ["0 1, .15873 1, .174603 .96875, .333333 .03125, .349206 0, .666667 0, .68254 .03125, .84127 .96875, .857143 1, 1 1",
            "0 0, .15873 .9375, .174603 1, .507937 1, .666667 .0625, .68254 0, 1 0", "0 0, .333333 0, .349206 .0625, .507937 1, .84127 1, .857143 .9375, 1 .09375"],
    "jet": ["0 0, .35 0, .66 1, .89 1, 1 .5", "0 0, .125 0, .375 1, .64 1, .91 0, 1 0", "0 .5, .11 1, .34 1, .65 0, 1 0"],
    "spring": ["0 1, 1 1", "0 0, 1 1", "0 1, 1 0"],
    "summer": ["0 0, 1 1", "0 .5, 1 1", "0 .4, 1 .4"],
    "autumn": ["0 1, 1 1", "0 0, 1 1", "0 0, 1 0"],
    "winter": ["0 0, 1 0", "0 0, 1 1", "0 1, 1 .5"],
    "terrain": ["0 .2, .15 0, .25 0, .5 1, .75 .5, 1 1", "0 .2, .15 .6, .25 .8, .5 1, .75 .36, 1 1", "0 .6, .15 1, .25 .4, .5 .6, .75 .33, 1 1"],
    "gist_stern": ["0 0, .0547 1, .25 .027 .25, 1 1", "0 0, 1 1", "0 0, .5 1, .735 0, 1 1"],
    "gist_earth": ["0 0, .2824 .1882, .4588 .2714, .549 .4719, .698 .7176, .7882 .7553, 1 .9922",
                   "0 0, .0275 0, .1098 .1893, .1647 .3035, .2078 .3841, .2824 .502, .5216 .6397, .698 .7171, .7882 .6392, .7922 .6413, .8 .6447, .8078 .6481, .8157 .6549, .8667 .6991, .8745 .7103, .8824 .7216, .8902 .7323, .898 .743, .9412 .8275, .9569 .8635, .9647 .8816, .9961 .9733, 1 .9843",
                   "0 0, .0039 .1684, .0078 .2212, .0275 .4329, .0314 .4549, .2824 .5004, .4667 .2748, .5451 .3205, .7843 .3961, .8941 .6651, 1 .9843"],
    "gist_ncar": ["0 0, .3098 0, .3725 .3993, .4235 .5003, .5333 1, .7922 1, .8471 .6218, .898 .9235, 1 .9961",
                  "0 0, .051 .3722, .1059 0, .1569 .7202, .1608 .7537, .1647 .7752, .2157 1, .2588 .9804, .2706 .9804, .3176 1, .3686 .8081, .4275 1, .5216 1, .6314 .7292, .6863 .2796, .7451 0, .7922 0, .8431 .1753, .898 .5, 1 .9725",
                  "0 .502, .051 .0222, .1098 1, .2039 1, .2627 .6145, .3216 0, .4157 0, .4745 .2342, .5333 0, .5804 0, .6314 .0549, .6902 0, .7373 0, .7922 .9738, .8 1, .8431 1, .898 .9341, 1 .9961"],
}
#: Twenty even steps of the three channels.
SPECTRUM = [
    "0 .4667 .5333 0 0 0 0 0 0 0 0 0 0 .7333 .9333 1 1 1 .8667 .8 .8",
    "0 0 0 0 0 .4667 .6 .6667 .6667 .6 .7333 .8667 1 1 .9333 .8 .6 0 0 0 .8",
    "0 .5333 .6 .6667 .8667 .8667 .8667 .6667 .5333 0 0 0 0 0 0 0 0 0 0 0 .8",
]
#: Coefficients of the published polynomial of degree five.
TURBO = [
    (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
]
#: Maps that are functions of the place alone.
FORMULAS = {
    "rainbow": (lambda x: abs(2 * x - 0.5), lambda x: math.sin(math.pi * x), lambda x: math.cos(math.pi / 2 * x)),
    "turbo": tuple((lambda x, c=c: sum(a * x**k for k, a in enumerate(c))) for c in TURBO),
    "pink": tuple((lambda x, k=k: math.sqrt((2 * x + band(x, stops(CHANNELS["hot"][k]))) / 3)) for k in range(3)),
}
NAMES = sorted({*SEQUENTIAL, *DIVERGING, *QUALITATIVE, *CHANNELS, *FORMULAS, "nipy_spectral"})


def stops(text: str) -> list[tuple[float, float, float]]:
    """(place, value before, value after) of a channel's stops."""
    rows = [[float(x) for x in part.split()] for part in text.split(",")]
    return [(r[0], r[1], r[-1]) for r in rows]


def band(at: float, points: list[tuple[float, float, float]]) -> float:
    """Value of a channel at a place from 0 to 1."""
    for (x, _, y), (x2, y2, _) in zip(points, points[1:]):
        if x <= at < x2 or at == x2 == points[-1][0]:
            return y + (y2 - y) * (at - x) / (x2 - x)
    return 0.0


def level(value: float) -> int:
    return min(255, max(0, math.floor(value * 255 + 0.5)))


def packed(red: int, green: int, blue: int, alpha: int = 255) -> int:
    return red << 24 | green << 16 | blue << 8 | alpha


def by_channel(channels: list[list[tuple[float, float, float]]], n: int = 256) -> list[int]:
    """A map whose channels are piecewise linear, each with stops of its own."""
    return [packed(*(level(band(k / (n - 1), c)) for c in channels)) for k in range(n)]


def by_functions(red, green, blue, n: int = 256) -> list[int]:
    return [packed(*(level(f(k / (n - 1))) for f in (red, green, blue))) for k in range(n)]


def qualitative(colours: list[int], n: int = 256) -> list[int]:
    """Bands without transitions."""
    return [colours[int(k / (n - 1) * (len(colours) - 1))] for k in range(n)]


def placed(colours: list[tuple[float, int]], n: int = 256) -> list[int]:
    """Piecewise linear between colours at given places."""
    channel = lambda s: [(x, (c >> s & 255) / 255, (c >> s & 255) / 255) for x, c in colours]
    return by_channel([channel(24), channel(16), channel(8)], n)


def even(colours: list[int], n: int = 256) -> list[int]:
    """Piecewise linear between evenly spaced colours."""
    last = len(colours) - 1
    return placed([(k / last if k < last else 1.0, c) for k, c in enumerate(colours)], n)


def by_name(name: str, n: int = 256) -> list[int]:
    """A built-in map, in any case; ``_r`` behind the name reverses it."""
    base = name.lower().removesuffix("_r")
    listed = lambda text: [int(c + "ff", 16) for c in text.split()]
    if base in SEQUENTIAL or base in DIVERGING:
        out = even(listed((SEQUENTIAL | DIVERGING)[base]), n)
    elif base in QUALITATIVE:
        out = qualitative(listed(QUALITATIVE[base]), n)
    elif base in CHANNELS:
        out = by_channel([stops(c) for c in CHANNELS[base]], n)
    elif base in FORMULAS:
        out = by_functions(*FORMULAS[base], n)
    elif base == "nipy_spectral":
        out = by_channel([[(k / 20, float(v), float(v)) for k, v in enumerate(c.split())] for c in SPECTRUM], n)
    else:
        raise ValueError(f"no colour map named {name}")
    return out[::-1] if name.lower().endswith("_r") else out


def faded(colours: list[int], fade_in: float = 0.0, fade_out: float = 1.0) -> list[int]:
    """Alpha rises from 0 over the first ``fade_in`` of the map and falls from its place ``fade_out`` on."""
    out, n = list(colours), len(colours)
    rise, fall = int(n * fade_in), int(n * fade_out)
    for k in range(rise):
        out[k] = out[k] & ~255 | int(k / rise * 255)
    for k in range(fall, n):
        out[k] = out[k] & ~255 | int(max(0.0, 1 - (k - fall) / max(1, n - fall)) * 255)
    return out
