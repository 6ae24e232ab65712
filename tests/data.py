"""A small public data set, and made ones."""

import numpy as np

def grouped(seed=1, groups=20, rows=15, slope_sd=0.5, crossed=0):
    """y = 2 + 1.5 x + b0 + b1 x + e, with a factor f and weights w; optionally a crossed grouping."""
    rng = np.random.default_rng(seed)
    g = np.repeat(np.arange(groups), rows)
    x = rng.normal(0, 1, len(g)).round(3)
    b = rng.normal(0, 1, (groups, 2)) * [1.0, slope_sd]
    f = rng.choice(["a", "b", "c"], len(g))
    y = 2 + 1.5 * x + b[g, 0] + b[g, 1] * x + (f == "b") * 0.7 + rng.normal(0, 0.8, len(g))
    out = {"y": y.round(4), "x": x, "f": f, "g": [f"g{v:03d}" for v in g], "w": rng.uniform(0.5, 2, len(g)).round(3), "o": rng.normal(0, 1, len(g)).round(3)}
    if crossed:
        h = rng.integers(0, crossed, len(g))
        out["h"] = [f"h{v:02d}" for v in h]
        out["y"] = (out["y"] + rng.normal(0, 1, crossed)[h]).round(4)
    return out

DYESTUFF = {"batch": [b for b in "ABCDEF" for _ in range(5)], "yield_": [1545, 1440, 1440, 1520, 1580, 1540, 1555, 1490, 1560, 1495, 1595, 1550, 1605, 1510, 1560, 1445, 1440, 1595, 1465, 1545, 1595, 1630, 1515, 1635, 1625, 1520, 1455, 1450, 1480, 1445]}

# Public data sets that mixed models are commonly checked on.

# Reaction times of 18 subjects on days 0 to 9 of restricted sleep, a row per subject.
SLEEP_SUBJECTS = [308, 309, 310, 330, 331, 332, 333, 334, 335, 337, 349, 350, 351, 352, 369, 370, 371, 372]
SLEEP = [
    [249.56, 258.7047, 250.8006, 321.4398, 356.8519, 414.6901, 382.2038, 290.1486, 430.5853, 466.3535],
    [222.7339, 205.2658, 202.9778, 204.707, 207.7161, 215.9618, 213.6303, 217.7272, 224.2957, 237.3142],
    [199.0539, 194.3322, 234.32, 232.8416, 229.3074, 220.4579, 235.4208, 255.7511, 261.0125, 247.5153],
    [321.5426, 300.4002, 283.8565, 285.133, 285.7973, 297.5855, 280.2396, 318.2613, 305.3495, 354.0487],
    [287.6079, 285.0, 301.8206, 320.1153, 316.2773, 293.3187, 290.075, 334.8177, 293.7469, 371.5811],
    [234.8606, 242.8118, 272.9613, 309.7688, 317.4629, 309.9976, 454.1619, 346.8311, 330.3003, 253.8644],
    [283.8424, 289.555, 276.7693, 299.8097, 297.171, 338.1665, 332.0265, 348.8399, 333.36, 362.0428],
    [265.4731, 276.2012, 243.3647, 254.6723, 279.0244, 284.1912, 305.5248, 331.5229, 335.7469, 377.299],
    [241.6083, 273.9472, 254.4907, 270.8021, 251.4519, 254.6362, 245.4523, 235.311, 235.7541, 237.2466],
    [312.3666, 313.8058, 291.6112, 346.1222, 365.7324, 391.8385, 404.2601, 416.6923, 455.8643, 458.9167],
    [236.1032, 230.3167, 238.9256, 254.922, 250.7103, 269.7744, 281.5648, 308.102, 336.2806, 351.6451],
    [256.2968, 243.4543, 256.2046, 255.5271, 268.9165, 329.7247, 379.4445, 362.9184, 394.4872, 389.0527],
    [250.5265, 300.0576, 269.8939, 280.5891, 271.8274, 304.6336, 287.7466, 266.5955, 321.5418, 347.5655],
    [221.6771, 298.1939, 326.8785, 346.8555, 348.7402, 352.8287, 354.4266, 360.4326, 375.6406, 388.5417],
    [271.9235, 268.4369, 257.2424, 277.6566, 314.8222, 317.2135, 298.1353, 348.1229, 340.28, 366.5131],
    [225.264, 234.5235, 238.9008, 240.473, 267.5373, 344.1937, 281.1481, 347.5855, 365.163, 372.2288],
    [269.8804, 272.4428, 277.8989, 281.7895, 279.1705, 284.512, 259.2658, 304.6306, 350.7807, 369.4692],
    [269.4117, 273.474, 297.5968, 310.6316, 287.1726, 329.6076, 334.4818, 343.2199, 369.1417, 364.1236],
]

# Strength of pastes, a row per batch A to J: two measures of each of the casks a, b, c.
PASTES = [
    [62.8, 62.6, 60.1, 62.3, 62.7, 63.1],
    [60.0, 61.4, 57.5, 56.9, 61.1, 58.9],
    [58.7, 57.5, 63.9, 63.1, 65.4, 63.7],
    [57.1, 56.4, 56.9, 58.6, 64.7, 64.5],
    [55.1, 55.1, 54.7, 54.2, 58.8, 57.5],
    [63.4, 64.9, 59.3, 58.1, 60.5, 60.0],
    [62.5, 62.6, 61.0, 58.7, 56.9, 57.7],
    [59.2, 59.4, 65.2, 66.0, 64.8, 64.1],
    [54.8, 54.8, 64.0, 64.0, 57.7, 56.8],
    [58.3, 59.3, 59.2, 59.2, 58.9, 56.6],
]

# Diameters of penicillin inhibition, a row per plate a to x: samples A to F.
PENICILLIN = [
    [27, 23, 26, 23, 23, 21],
    [27, 23, 26, 23, 23, 21],
    [25, 21, 25, 24, 24, 20],
    [26, 23, 25, 23, 23, 20],
    [25, 22, 26, 22, 23, 20],
    [24, 22, 25, 23, 22, 19],
    [24, 20, 23, 21, 22, 19],
    [26, 22, 26, 24, 24, 21],
    [24, 21, 24, 22, 22, 20],
    [24, 21, 24, 23, 22, 19],
    [26, 23, 26, 24, 24, 21],
    [25, 22, 26, 24, 24, 20],
    [26, 24, 26, 24, 25, 22],
    [26, 23, 26, 23, 23, 20],
    [26, 23, 25, 24, 24, 22],
    [25, 22, 25, 23, 23, 20],
    [25, 21, 24, 23, 23, 20],
    [25, 22, 24, 23, 23, 19],
    [24, 21, 23, 21, 21, 19],
    [26, 23, 26, 24, 24, 21],
    [25, 21, 24, 22, 22, 18],
    [25, 22, 25, 22, 22, 20],
    [24, 21, 24, 22, 24, 19],
    [24, 21, 24, 22, 21, 18],
]


def sleep():
    return {"Reaction": [v for row in SLEEP for v in row], "Days": list(range(10)) * 18, "Subject": [str(s) for s in SLEEP_SUBJECTS for _ in range(10)]}


def pastes():
    return {"strength": [v for row in PASTES for v in row], "batch": [b for b in "ABCDEFGHIJ" for _ in range(6)], "cask": list("aabbcc") * 10}


def penicillin():
    return {"diameter": [v for row in PENICILLIN for v in row], "plate": [p for p in "abcdefghijklmnopqrstuvwx" for _ in range(6)], "sample": list("ABCDEF") * 24}
