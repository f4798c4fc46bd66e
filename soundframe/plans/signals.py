"""Registered queries on mel bands, keys, tempo, splits and displays, over the signal view."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundframe.functions import text
from soundframe.operators import features as T
from soundframe.operators import maintain as M
from soundframe.operators import signal as S
from soundframe.plans import views as V
from soundframe.plans.queries import ENV, FR, HOP, N_FFT, PW, RATE, SIZE, SPEC, _analysed, _blocks, _env, _power, query, six

SIG = V.SIGNAL
BANDS, COEFFICIENTS, PER_SECOND = 8, 5, RATE / HOP
LEN = "len AS (SELECT clip_id, count(*) AS len FROM signal GROUP BY ALL)"
MELW = f"""ed AS (SELECT i, 700 * (power(10, i * log10(1 + {RATE / 2} / 700) / {BANDS + 1}) - 1) * {N_FFT} / {RATE} AS e FROM (SELECT unnest(range(0, {BANDS + 2})) AS i)),
mw AS (SELECT a.i AS band, k, CASE WHEN k BETWEEN a.e AND b.e THEN (k - a.e) / (b.e - a.e) WHEN k > b.e AND k <= c.e THEN (c.e - k) / (c.e - b.e) ELSE 0 END AS w FROM ed a JOIN ed b ON b.i = a.i + 1 JOIN ed c ON c.i = a.i + 2, (SELECT unnest(range(0, {N_FFT // 2 + 1})) AS k)),
ml AS (SELECT clip_id, frame, band, sum(p * w) AS v FROM pw JOIN mw USING (k) GROUP BY ALL)"""
MFCC = f"""mc AS (SELECT clip_id, frame, c, sum(ln(v + 1e-10) * cos(pi() / {BANDS} * (band + 0.5) * c)) * CASE WHEN c = 0 THEN sqrt(1.0 / {BANDS}) ELSE sqrt(2.0 / {BANDS}) END AS x FROM ml, (SELECT unnest(range(0, {COEFFICIENTS})) AS c) GROUP BY clip_id, frame, c)"""


FNV_OF = "h AS (SELECT id, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(path, ''), lambda c: ascii(c)::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616::HUGEINT) AS h FROM {})"


def _mel(spark, sf):
    return _analysed(spark, sf, T.mel_column(N_FFT, RATE, BANDS))


@query("power_db", SIG, FR, PW, select="SELECT clip_id, frame, round(sum(greatest(10 * log10(greatest(p, 1e-10) / 4), -30.0)), 6) AS db FROM pw GROUP BY ALL")
def power_db(spark, sf):
    return _power(spark, sf).select("clip_id", "frame", F.round(S.total(F.transform("power", lambda p: S.power_db(p, 2.0, 30.0))), 6).alias("db"))


@query("mel", SIG, FR, PW, MELW, select="SELECT clip_id, CAST(band AS INT) AS band, round(avg(v), 6) AS power FROM ml GROUP BY ALL")
def mel(spark, sf):
    return _mel(spark, sf).select("clip_id", F.posexplode("mel").alias("band", "v")).groupBy("clip_id", "band").agg(F.round(F.avg("v"), 6).alias("power"))


@query("mfcc", SIG, FR, PW, MELW, MFCC, select="SELECT clip_id, CAST(c AS INT) AS c, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM mc GROUP BY ALL")
def mfcc(spark, sf):
    m = T.array_stats(_analysed(spark, sf, T.mfcc_column(N_FFT, RATE, BANDS, COEFFICIENTS)), "mfcc", COEFFICIENTS)
    return m.select("clip_id", F.posexplode(F.arrays_zip("mean", "std")).alias("c", "x")).select("clip_id", "c", F.round("x.mean", 6).alias("mean"), F.round("x.std", 6).alias("std"))


CHROMA = f"""cb AS (SELECT k, CAST(floor(12 * log2(k * {RATE / N_FFT} / 440) + 69.5) AS INT) % 12 AS pc FROM (SELECT unnest(range(1, {N_FFT // 2 + 1})) AS k) WHERE 12 * log2(k * {RATE / N_FFT} / 440) + 69 BETWEEN 0 AND 127),
cf AS (SELECT clip_id, frame, pc, sum(p) AS v FROM pw JOIN cb USING (k) GROUP BY ALL), nf AS (SELECT clip_id, count(DISTINCT frame) AS n FROM pw GROUP BY ALL), ca AS (SELECT clip_id, q.pc, coalesce(sum(v), 0) / max(n) AS v FROM nf CROSS JOIN (SELECT unnest(range(0, 12)) AS pc) q LEFT JOIN cf USING (clip_id, pc) GROUP BY ALL),
ch AS (SELECT clip_id, pc, v / nullif(sum(v) OVER (PARTITION BY clip_id), 0) AS v FROM ca)"""


def _chroma(spark, sf):
    return T.chroma(_analysed(spark, sf, T.chroma_column(N_FFT, RATE)))


@query("chroma", SIG, FR, PW, CHROMA, select="SELECT clip_id, CAST(pc AS INT) AS pitch_class, round(v, 6) AS share FROM ch")
def chroma(spark, sf):
    return _chroma(spark, sf).select("clip_id", F.posexplode("chroma").alias("pitch_class", "v")).select("clip_id", "pitch_class", F.round("v", 6).alias("share"))


PROFILES = f"""pr AS (SELECT o * 12 + t AS i, {T.TONICS}[t + 1] AS key, CASE WHEN o = 0 THEN 'major' ELSE 'minor' END AS mode, pc, (CASE WHEN o = 0 THEN {T.MAJOR_WEIGHTS} ELSE {T.MINOR_WEIGHTS} END)[(pc - t + 12) % 12 + 1]::DOUBLE AS w
FROM (SELECT unnest(range(0, 2)) AS o), (SELECT unnest(range(0, 12)) AS t), (SELECT unnest(range(0, 12)) AS pc)),
kr AS (SELECT clip_id, i, key, mode, coalesce(corr(v, w), 0) AS r FROM ch JOIN pr USING (pc) GROUP BY ALL), ko AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY round(r, 9) DESC, i) AS place FROM kr)"""


@query("key_detect", SIG, FR, PW, CHROMA, PROFILES, select="SELECT clip_id, max(key) FILTER (place = 1) AS key, max(mode) FILTER (place = 1) AS mode, round(max((r + 1) / 2) FILTER (place = 1), 6) AS confidence, string_agg(key || ' ' || mode, ',' ORDER BY place) FILTER (place BETWEEN 2 AND 4) AS alternates FROM ko GROUP BY clip_id")
def key_detect(spark, sf):
    return T.keys(_chroma(spark, sf)).select("clip_id", "key", "mode", F.round("confidence", 6).alias("confidence"), F.array_join(F.transform("alternates", lambda a: F.concat_ws(" ", a.key, a.mode)), ",").alias("alternates"))


LAGS = """e0 AS (SELECT clip_id, sum(env * env) AS s0, count(*) AS n FROM env GROUP BY ALL), ac AS (SELECT a.clip_id, b.frame - a.frame AS lag, sum(a.env * b.env) / max(s0) AS r FROM env a JOIN env b ON a.clip_id = b.clip_id AND b.frame - a.frame BETWEEN 6 AND 20 JOIN e0 ON e0.clip_id = a.clip_id GROUP BY 1, 2),
tw AS (SELECT clip_id, lag, r, r * exp(-power(1200.0 / lag - 120, 2) / 3200) AS w, 1 AS o FROM ac UNION ALL SELECT clip_id, lag, r, r, 0 FROM ac WHERE lag = 6)"""


TEMPO = "tb AS (SELECT clip_id, round(1200.0 / lag, 6) AS bpm, round(least(1, greatest(0, r)), 6) AS confidence FROM tw QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY w DESC, o, lag) = 1)"
QUALITY = "qm AS (SELECT clip_id, avg(x) AS mean FROM signal GROUP BY ALL), ql AS (SELECT clip_id, 20 * log10(sqrt(avg(power(x - mean, 2)))) AS rms_db, 20 * log10(max(abs(x - mean))) AS peak_db, avg(CASE WHEN abs(x) >= 0.99 THEN 1.0 ELSE 0 END) > 0.0001 AS clipping_detected FROM signal JOIN qm USING (clip_id) GROUP BY clip_id)"


@query("tempo_bpm", SIG, FR, PW, ENV, LAGS, select="SELECT clip_id, round(1200.0 / lag, 6) AS bpm, round(least(1, greatest(0, r)), 6) AS confidence FROM tw QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY w DESC, o, lag) = 1")
def tempo_bpm(spark, sf):
    return six(T.tempo(_env(spark, sf), PER_SECOND), "bpm", "confidence")


@query("onsets_spaced", SIG, FR, PW, ENV, "pk AS (SELECT clip_id, frame FROM (SELECT *, lag(env) OVER w AS p, lead(env) OVER w AS q FROM env WINDOW w AS (PARTITION BY clip_id ORDER BY frame)) WHERE env > 0.1 AND env > p AND env >= q)", select="SELECT clip_id, unnest(list_reduce(list([frame] ORDER BY frame), lambda a, x: CASE WHEN x[1] - a[-1] >= 4 THEN list_concat(a, x) ELSE a END)) AS frame FROM pk GROUP BY clip_id")
def onsets_spaced(spark, sf):
    return S.onsets(_env(spark, sf), gap=4)


WALK = """bp AS (SELECT clip_id, CAST(floor(60 / bpm * 20 + 0.5) AS BIGINT) AS period FROM tb), nb AS (SELECT a.clip_id, a.frame AS due, a.env, period, arg_max(b.frame, (b.env, -b.frame)) AS near, max(b.env) AS top FROM env a JOIN bp USING (clip_id) JOIN env b ON b.clip_id = a.clip_id AND b.frame BETWEEN a.frame - period // 4 AND a.frame + period // 4 GROUP BY ALL),
nx AS (SELECT clip_id, due, CASE WHEN top > env THEN near ELSE due END AS frame, period FROM nb), fs AS (SELECT clip_id, coalesce(min(frame) FILTER (env > 0.3), 0) AS due FROM env GROUP BY ALL), wk AS (SELECT nx.clip_id, nx.frame, nx.period FROM fs JOIN nx USING (clip_id, due) UNION ALL SELECT nx.clip_id, nx.frame, nx.period FROM wk JOIN nx ON nx.clip_id = wk.clip_id AND nx.due = wk.frame + wk.period)"""


BACK = """ob AS (SELECT clip_id, frame, env, lag(env) OVER w AS p, lead(env) OVER w AS q, list([frame, env]) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING) AS h FROM env WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
op AS (SELECT clip_id, frame, list_reduce(list_prepend([env, frame, 0, env], list_reverse(h)[1:10]), lambda a, x: CASE WHEN a[3] = 1 THEN a WHEN x[2] > a[4] THEN [a[1], a[2], 1, x[2]] WHEN x[2] <= a[1] THEN [x[2], x[1], 0, x[2]] ELSE [a[1], a[2], 0, x[2]] END)[2] AS onset FROM ob WHERE env > 0.1 AND env > p AND env >= q)"""


@query("onsets_backtracked", SIG, FR, PW, ENV, BACK, select="SELECT clip_id, CAST(onset AS BIGINT) AS frame FROM op")
def onsets_backtracked(spark, sf):
    """Onsets moved back to where the envelope began to rise."""
    return S.onsets(_env(spark, sf), backtrack=True)


@query("beats", "RECURSIVE " + SIG, FR, PW, ENV, LAGS, TEMPO, WALK, select="SELECT clip_id, frame FROM wk")
def beats(spark, sf):
    env = _env(spark, sf)
    return T.beats(env, T.tempo(env, PER_SECOND), PER_SECOND)


@query("resample", SIG, LEN, select="""SELECT o.clip_id, CAST(o.i AS BIGINT) AS n, round(CASE WHEN b.x IS NULL THEN a.x ELSE a.x * (1 - (o.i * 2.56::DOUBLE - floor(o.i * 2.56::DOUBLE))) + b.x * (o.i * 2.56::DOUBLE - floor(o.i * 2.56::DOUBLE)) END, 6) AS x
FROM (SELECT clip_id, unnest(range(0, CAST(floor(len / 2.56::DOUBLE) AS BIGINT))) AS i FROM len) o JOIN signal a ON a.clip_id = o.clip_id AND a.n = CAST(floor(o.i * 2.56::DOUBLE) AS BIGINT) LEFT JOIN signal b ON b.clip_id = o.clip_id AND b.n = CAST(floor(o.i * 2.56::DOUBLE) AS BIGINT) + 1""")
def resample(spark, sf):
    return six(T.resample(_blocks(spark, sf), RATE, 250.0, SIZE), "x")


@query("downsample", SIG, LEN, select="SELECT o.clip_id, CAST(i AS BIGINT) AS i, round(x, 6) AS x FROM (SELECT clip_id, len, unnest(range(0, least(len, 100))) AS i FROM len) o JOIN signal s ON s.clip_id = o.clip_id AND s.n = CASE WHEN len <= 100 THEN i ELSE CAST(floor(i * (len / 100)) AS BIGINT) END")
def downsample(spark, sf):
    return six(T.downsample(_blocks(spark, sf), 100, SIZE), "x")


@query("beat_segments", SIG, LEN, "g AS (SELECT clip_id, len, CAST(ceil(len / 349) AS BIGINT) AS n, unnest(range(0, CAST(ceil(len / 349) AS BIGINT), 6)) AS i FROM len)", select='SELECT clip_id, CAST(i // 6 AS INT) AS part, CASE WHEN n < 2 THEN 0 ELSE i * 349 END AS start, CASE WHEN n < 2 THEN len WHEN least(i + 6, n - 1) + 1 < n THEN least(i + 6, n - 1) * 349 ELSE len END AS "end" FROM g')
def beat_segments(spark, sf):
    return T.beat_chunks(S.lengths(_blocks(spark, sf)), F.lit(110.0), RATE, 2, 3)


STEPS = """ft AS (SELECT clip_id, frame, c, x FROM mc UNION ALL SELECT clip_id, frame, 99, coalesce(sum(p * k * 10) / nullif(sum(p), 0), 0) / 10000 FROM pw GROUP BY ALL),
sd AS (SELECT clip_id, frame, sqrt(sum(power(x - q, 2))) AS d FROM (SELECT *, lag(x, 1, x) OVER (PARTITION BY clip_id, c ORDER BY frame) AS q FROM ft) GROUP BY ALL), sl AS (SELECT clip_id, avg(d) + 1.5 * stddev_pop(d) AS lim FROM sd GROUP BY ALL),
cp AS (SELECT clip_id, frame FROM (SELECT *, lag(d) OVER w AS p, lead(d) OVER w AS q FROM sd WINDOW w AS (PARTITION BY clip_id ORDER BY frame)) JOIN sl USING (clip_id) WHERE d > p AND d > q AND d > lim)"""


def _features(spark, sf):
    return T.step_features(_blocks(spark, sf), RATE, N_FFT, HOP, SIZE, BANDS, COEFFICIENTS)


@query("changepoints", SIG, FR, PW, MELW, MFCC, STEPS, select="SELECT clip_id, unnest(list_reduce(list_prepend([0], list([frame] ORDER BY frame)), lambda a, x: CASE WHEN x[1] - a[-1] >= 4 THEN list_concat(a, x) ELSE a END)[2:]) AS frame FROM cp GROUP BY clip_id")
def changepoints(spark, sf):
    return T.change_points(_features(spark, sf), 4)


def _rounds(count: int, least: int) -> str:
    """SQL of count rounds that split the part of each clip where it lowers the summed variance most."""
    out = ["cf AS (SELECT clip_id, frame, c, x - avg(x) OVER (PARTITION BY clip_id, c) AS x FROM ft)", f"p0 AS (SELECT clip_id, 0 AS a, count(*) AS b FROM (SELECT DISTINCT clip_id, frame FROM ft) GROUP BY clip_id HAVING count(*) >= {2 * least})"]
    for i in range(1, count + 1):
        out += [
            f"s{i} AS (SELECT f.clip_id, a, b, frame, coalesce(sum(x) OVER (PARTITION BY f.clip_id, a, c ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l, sum(x) OVER (PARTITION BY f.clip_id, a, c) AS t FROM cf f JOIN p{i - 1} p ON p.clip_id = f.clip_id AND frame >= a AND frame < b)",
            f"w{i} AS (SELECT clip_id, a, b, frame FROM s{i} WHERE frame - a >= {least} AND b - frame >= {least} GROUP BY clip_id, a, b, frame QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY round(sum(l * l / (frame - a) + (t - l) * (t - l) / (b - frame) - t * t / (b - a)), 9) DESC, frame) = 1)",
            f"p{i} AS (SELECT p.clip_id, p.a, coalesce(frame, p.b) AS b FROM p{i - 1} p LEFT JOIN w{i} w ON w.clip_id = p.clip_id AND w.a = p.a UNION ALL SELECT clip_id, frame, b FROM w{i})",
        ]
    return ",\n".join(out)


@query("n_segments", SIG, LEN, FR, PW, MELW, MFCC, STEPS, _rounds(3, 4), select='SELECT clip_id, CAST(row_number() OVER w - 1 AS INT) AS part, CAST(32 * a AS BIGINT) AS start, CAST(coalesce(lead(32 * a) OVER w, len) AS BIGINT) AS "end" FROM p3 JOIN len USING (clip_id) WINDOW w AS (PARTITION BY clip_id ORDER BY a)')
def n_segments(spark, sf):
    b = _blocks(spark, sf)
    return T.chunks(T.n_segments(_features(spark, sf), 4, 4), S.lengths(b), HOP)


LOOPS = """cr AS (SELECT clip_id, len, n, n < least(64, len // 4) - 1 AS early, n >= len - least(64, len // 4) AS late, (x >= 0) <> (lead(x) OVER (PARTITION BY clip_id ORDER BY n) >= 0) AS turn FROM signal JOIN len USING (clip_id)),
lb AS (SELECT clip_id, max(len) AS len, min(n) FILTER (turn AND early) AS a, max(n) FILTER (turn AND late) AS b FROM cr GROUP BY clip_id), le AS (SELECT clip_id, len, a IS NOT NULL AND b IS NOT NULL AS aligned, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE a END AS s, CASE WHEN a IS NULL OR b IS NULL THEN len - 1 ELSE b END AS e FROM lb WHERE len >= 64),
ls AS (SELECT clip_id, sum(abs(x)) FILTER (n >= s AND n < s + least(32, len // 4)) / any_value(least(32, len // 4)) AS p, sum(abs(x)) FILTER (n BETWEEN greatest(e - least(32, len // 4), 0) AND e) / any_value(least(32, len // 4)) AS q FROM signal JOIN le USING (clip_id) GROUP BY clip_id),
lf AS (SELECT clip_id, 'p' AS side, n - s AS j, x FROM signal JOIN le USING (clip_id) WHERE n >= s AND n < s + 64 UNION ALL SELECT clip_id, 'q', n - (e - 64), x FROM signal JOIN le USING (clip_id) WHERE n BETWEEN e - 64 AND e),
lg AS (SELECT clip_id, side, (j + 32) // 64 AS f, (j + 32) % 64 AS t, x FROM lf), lh AS (SELECT clip_id, side, f, k, power(sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 63)) * cos(2 * pi() * k * t / 64)), 2) + power(sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 63)) * sin(2 * pi() * k * t / 64)), 2) AS v FROM lg, (SELECT unnest(range(0, 33)) AS k) GROUP BY ALL),
lm AS (SELECT clip_id, k, sum(v) FILTER (side = 'p') AS p, sum(v) FILTER (side = 'q') AS q FROM lh GROUP BY ALL), lc AS (SELECT clip_id, least(1, greatest(0, coalesce(sum(p * q) / nullif(sqrt(sum(p * p)) * sqrt(sum(q * q)), 0), 0))) AS c FROM lm GROUP BY clip_id),
lq AS (SELECT clip_id, s, e, aligned, CASE WHEN p > 0 AND q > 0 THEN least(p, q) / greatest(p, q) WHEN p = q THEN 1 ELSE 0 END::DOUBLE AS level, CASE WHEN s + 64 > len OR e < 64 THEN 0.5 ELSE c END::DOUBLE AS alike FROM le JOIN ls USING (clip_id) JOIN lc USING (clip_id))"""


@query("loop_quality", SIG, LEN, LOOPS, select="SELECT clip_id, s AS loop_start, e AS loop_end, aligned, round(level, 6) AS amplitude, round(alike, 6) AS spectrum, round(0.5 * alike + 0.3 * level + CASE WHEN aligned THEN 0.2 ELSE 0.1 END, 6) AS quality, 0.5 * alike + 0.3 * level + CASE WHEN aligned THEN 0.2 ELSE 0.1 END >= 0.7 AS is_loopable FROM lq")
def loop_quality(spark, sf):
    return six(T.loop_quality(_blocks(spark, sf), RATE, SIZE, 0.1, 32, N_FFT), "amplitude", "spectrum", "quality")


FREQ = """fh AS (SELECT clip_id, len, len // 40 AS hop, unnest(range(0, 1 + len // (len // 40))) AS frame FROM len), fs AS (SELECT fh.clip_id, frame, t, x FROM fh, (SELECT unnest(range(0, 128)) AS t) tt, signal s WHERE s.clip_id = fh.clip_id AND s.n = frame * hop - 64 + t),
fm AS (SELECT clip_id, frame, k, sqrt(power(sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 127)) * cos(2 * pi() * k * t / 128)), 2) + power(sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 127)) * sin(2 * pi() * k * t / 128)), 2)) AS a FROM fs, (SELECT unnest(range(0, 65)) AS k) GROUP BY ALL),
fc AS (SELECT clip_id, frame, CASE WHEN sum(a) > 1e-10 THEN sum(a * k * 5) / sum(a) ELSE 0 END AS c FROM fm GROUP BY ALL), fn AS (SELECT clip_id, count(*) AS frames FROM fc GROUP BY ALL), fb AS (SELECT clip_id, bar, bar * ((frames - 1) / 39) AS p FROM fn, (SELECT unnest(range(0, 40)) AS bar)),
fp AS (SELECT b.clip_id, b.bar, coalesce(max(abs(x)), 0) AS peak FROM (SELECT clip_id, len, unnest(range(0, 40)) AS bar FROM len) b LEFT JOIN signal s ON s.clip_id = b.clip_id AND CAST(floor(s.n / ceil(len / 40)) AS INT) = bar GROUP BY ALL)"""


@query("freq_waveform", SIG, LEN, FREQ, select="SELECT fb.clip_id, CAST(fb.bar AS INT) AS bar, round(peak, 6) AS peak, round(a.c + coalesce(b.c - a.c, 0) * (p - floor(p)), 6) AS centroid FROM fb JOIN fp USING (clip_id, bar) JOIN fc a ON a.clip_id = fb.clip_id AND a.frame = CAST(floor(p) AS BIGINT) LEFT JOIN fc b ON b.clip_id = fb.clip_id AND b.frame = CAST(floor(p) AS BIGINT) + 1")
def freq_waveform(spark, sf):
    return six(T.frequency_waveform(_blocks(spark, sf), RATE, 40, SIZE, 128), "peak", "centroid")


GRAM = """gh AS (SELECT clip_id, len // 20 AS hop, unnest(range(0, 1 + len // (len // 20))) AS frame FROM len), gs AS (SELECT gh.clip_id, frame, t, x FROM gh, (SELECT unnest(range(0, 64)) AS t) tt, signal s WHERE s.clip_id = gh.clip_id AND s.n = frame * hop - 32 + t),
gp AS (SELECT clip_id, frame, k, power(sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 63)) * cos(2 * pi() * k * t / 64)), 2) + power(sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 63)) * sin(2 * pi() * k * t / 64)), 2) AS p FROM gs, (SELECT unnest(range(0, 33)) AS k) GROUP BY ALL),
gv AS (SELECT clip_id, frame, k, least(1, greatest(0, (greatest(10 * log10(greatest(p, 1e-10) / greatest(max(p) OVER (PARTITION BY clip_id), 1e-10)), -80) + 80) / 80)) AS v FROM gp), gn AS (SELECT clip_id, max(frame) AS last FROM gv GROUP BY ALL), gc AS (SELECT clip_id, col, col * (last / 19) AS p FROM gn, (SELECT unnest(range(0, 20)) AS col)),
gw AS (SELECT gc.clip_id, col, a.k, a.v + coalesce(b.v - a.v, 0) * (p - floor(p)) AS v FROM gc JOIN gv a ON a.clip_id = gc.clip_id AND a.frame = CAST(floor(p) AS BIGINT) LEFT JOIN gv b ON b.clip_id = gc.clip_id AND b.frame = CAST(floor(p) AS BIGINT) + 1 AND b.k = a.k),
gr AS (SELECT r AS row, r * (32 / 11) AS p FROM (SELECT unnest(range(0, 12)) AS r))"""


@query("spectrogram", SIG, LEN, GRAM, select="SELECT a.clip_id, CAST(a.col AS INT) AS col, CAST(row AS INT) AS row, round(a.v + coalesce(b.v - a.v, 0) * (p - floor(p)), 6) AS x FROM gr JOIN gw a ON a.k = CAST(floor(p) AS BIGINT) LEFT JOIN gw b ON b.clip_id = a.clip_id AND b.col = a.col AND b.k = a.k + 1")
def spectrogram(spark, sf):
    v = T.spectrogram(_blocks(spark, sf), RATE, 20, 12, SIZE, N_FFT, "linear")
    return v.select("clip_id", "col", F.posexplode("v").alias("row", "x")).select("clip_id", "col", "row", F.round("x", 6).alias("x"))


MELGRAM = GRAM.split("gv AS")[0] + f"""me AS (SELECT i, 700 * (power(10, i * log10(1 + {RATE / 2} / 700) / 11) - 1) * {N_FFT} / {RATE} AS e FROM (SELECT unnest(range(0, 12)) AS i)), mf AS (SELECT a.i AS band, k, CASE WHEN k BETWEEN a.e AND b.e THEN (k - a.e) / (b.e - a.e) WHEN k > b.e AND k <= c.e THEN (c.e - k) / (c.e - b.e) ELSE 0 END AS w FROM me a JOIN me b ON b.i = a.i + 1 JOIN me c ON c.i = a.i + 2, (SELECT unnest(range(0, {N_FFT // 2 + 1})) AS k)),
gb AS (SELECT clip_id, frame, band AS k, sum(p * w) AS p FROM gp JOIN mf USING (k) GROUP BY ALL), gv AS""" + GRAM.split("gv AS")[1].split("gr AS")[0].rstrip().rstrip(",").replace("FROM gp)", "FROM gb)")


@query("spectrogram_mel", SIG, LEN, MELGRAM, select="SELECT clip_id, CAST(col AS INT) AS col, CAST(k AS INT) AS row, round(v, 6) AS x FROM gw")
def spectrogram_mel(spark, sf):
    v = T.spectrogram(_blocks(spark, sf), RATE, 20, 10, SIZE, N_FFT, "mel")
    return v.select("clip_id", "col", F.posexplode("v").alias("row", "x")).select("clip_id", "col", "row", F.round("x", 6).alias("x"))


BARS = """bb AS (SELECT clip_id, least(n // (len // 30), 29) AS bar, n - least(n // (len // 30), 29) * (len // 30) AS i, x FROM signal JOIN len USING (clip_id)), bm AS (SELECT clip_id, bar, count(*) AS m, CAST(power(2, ceil(log2(count(*)))) AS BIGINT) AS size, max(abs(x)) AS peak FROM bb GROUP BY ALL),
bd AS (SELECT clip_id, bar, k, size, sqrt(power(sum(x * (0.5 - 0.5 * cos(2 * pi() * i / (m - 1))) * cos(2 * pi() * k * i / size)), 2) + power(sum(x * (0.5 - 0.5 * cos(2 * pi() * i / (m - 1))) * sin(2 * pi() * k * i / size)), 2)) AS a FROM bb JOIN (SELECT *, unnest(range(1, size // 2)) AS k FROM bm) USING (clip_id, bar) GROUP BY ALL)"""


@query("bars", SIG, LEN, BARS, select="SELECT clip_id, CAST(bar AS INT) AS bar, round(max(peak), 6) AS peak, round(sum(a * k * 640 / bd.size) / sum(a), 6) AS centroid FROM bd JOIN bm USING (clip_id, bar) GROUP BY clip_id, bar")
def bars(spark, sf):
    return six(T.bars(_blocks(spark, sf), 30, RATE, SIZE), "peak", "centroid")


CHUNKS = """ck AS (SELECT clip_id, n // 96 AS chunk, n % 96 AS i, x FROM signal JOIN len USING (clip_id) WHERE n // 96 < len // 96), cd AS (SELECT clip_id, chunk, k, sqrt(power(sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 95)) * cos(2 * pi() * k * i / 128)), 2) + power(sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 95)) * sin(2 * pi() * k * i / 128)), 2)) AS a FROM ck, (SELECT unnest(range(1, 64)) AS k) GROUP BY ALL),
cc AS (SELECT clip_id, chunk, sum(a * k * 5) / sum(a) AS c FROM cd GROUP BY ALL), cp AS (SELECT clip_id, chunk, max(abs(x)) AS p FROM ck GROUP BY ALL), ct AS (SELECT clip_id, len // 96 AS t FROM len), cb AS (SELECT clip_id, bar, CAST(floor(bar * (t / 20)) AS BIGINT) AS a, CAST(floor((bar + 1) * (t / 20)) AS BIGINT) AS b FROM ct, (SELECT unnest(range(0, 20)) AS bar))"""


@query("chunk_bars", SIG, LEN, CHUNKS, select="SELECT clip_id, CAST(bar AS INT) AS bar, round(max(p), 6) AS peak, round(avg(c), 6) AS centroid FROM cb JOIN cp USING (clip_id) JOIN cc USING (clip_id, chunk) WHERE chunk >= a AND chunk < b GROUP BY ALL")
def chunk_bars(spark, sf):
    """The growing waveform of each clip in chunks of 96 samples, shown in twenty bars."""
    return six(T.chunk_bars(T.recording_chunks(_blocks(spark, sf), RATE, 96, SIZE), 20), "peak", "centroid")


EIGHTHS = "sub AS (SELECT clip_id * 8 + n // (len // 8) AS clip_id, n % (len // 8) AS n, x FROM signal JOIN len USING (clip_id) WHERE n // (len // 8) < 8)"
FR8, PW8 = FR.replace("fr AS", "fr8 AS").replace("FROM signal", "FROM sub"), PW.replace("pw AS", "pw8 AS").replace("FROM fr,", "FROM fr8,")
VECTOR = f"""mm AS (SELECT clip_id, c, avg(x) AS mean, stddev_pop(x) AS std FROM mc GROUP BY ALL), ro AS (SELECT clip_id, avg(r) AS rolloff FROM (SELECT clip_id, frame, CASE WHEN max(t) > 0 THEN min(k) FILTER (s >= 0.85 * t) * 10 ELSE 0 END AS r FROM (SELECT *, sum(p) OVER (PARTITION BY clip_id, frame ORDER BY k) AS s, sum(p) OVER (PARTITION BY clip_id, frame) AS t FROM pw) GROUP BY ALL) GROUP BY ALL),
lv AS (SELECT clip_id // 8 AS clip_id, clip_id % 8 AS part, least(1, 2 * sqrt(avg(x * x))) AS v FROM sub GROUP BY sub.clip_id), tn AS (SELECT clip_id // 8 AS clip_id, clip_id % 8 AS part, avg(coalesce(c, 0)) / 10000 AS v FROM (SELECT pw8.clip_id, frame, sum(p * k * 10) / nullif(sum(p), 0) AS c FROM pw8 JOIN len ON len.clip_id = pw8.clip_id // 8 WHERE frame <= len // 8 // 32 GROUP BY ALL) t8 GROUP BY t8.clip_id),
zz AS (SELECT clip_id, avg(CASE WHEN (x >= 0) <> (prev >= 0) THEN 1.0 ELSE 0 END) AS v FROM (SELECT clip_id, x, lag(x) OVER (PARTITION BY clip_id ORDER BY n) AS prev FROM signal) WHERE prev IS NOT NULL GROUP BY clip_id),
va AS (SELECT clip_id, c AS i, mean AS v FROM mm UNION ALL SELECT clip_id, 13 + c, std FROM mm UNION ALL SELECT clip_id, 26, centroid / 10000 FROM m UNION ALL SELECT clip_id, 27, rolloff / 20000 FROM ro UNION ALL SELECT clip_id, 28, avg(b) / 5000 FROM b GROUP BY clip_id UNION ALL SELECT clip_id, 29, flatness FROM m
UNION ALL SELECT clip_id, 30 + part, v FROM lv UNION ALL SELECT clip_id, 38 + part, v FROM tn UNION ALL SELECT clip_id, 46, v FROM zz UNION ALL SELECT clip_id, 47, least(1, greatest(0, (peak_db - rms_db + 20) / 40)) FROM ql)"""
WIDE = MELW.replace(f"/ {BANDS + 1}) - 1)", "/ 33) - 1)").replace(f"range(0, {BANDS + 2})", "range(0, 34)"), MFCC.replace(f"pi() / {BANDS} ", "pi() / 32 ").replace(f"1.0 / {BANDS}", "1.0 / 32").replace(f"2.0 / {BANDS}", "2.0 / 32").replace(f"range(0, {COEFFICIENTS})", "range(0, 13)")


@query("clip_vector", SIG, LEN, FR, PW, SPEC, *WIDE, EIGHTHS, FR8, PW8, QUALITY, VECTOR, select="SELECT clip_id, CAST(i AS INT) AS i, round(v / sqrt(sum(v * v) OVER (PARTITION BY clip_id)), 6) AS x FROM va")
def clip_vector(spark, sf):
    v = T.clip_vectors(_blocks(spark, sf), RATE, SIZE, N_FFT, HOP, 32)
    return v.select("clip_id", F.posexplode("v").alias("i", "x")).select("clip_id", "i", F.round("x", 6).alias("x"))


@query("analyze_standard", SIG, FR, PW, SPEC, ENV, LAGS, TEMPO, CHROMA, PROFILES, QUALITY, select="SELECT clip_id, bpm, key, mode, round((r + 1) / 2, 6) AS key_confidence, round(rms_db, 6) AS rms_db, clipping_detected, round(centroid, 6) AS centroid, round(flatness, 6) AS flatness, '' AS errors FROM m JOIN tb USING (clip_id) JOIN ql USING (clip_id) JOIN ko USING (clip_id) WHERE place = 1")
def analyze_standard(spark, sf):
    a = T.analyze(_blocks(spark, sf), RATE, SIZE, N_FFT, HOP, N_FFT)
    return six(a, "bpm", "key_confidence", "rms_db", "centroid", "flatness").select("clip_id", "bpm", "key", "mode", "key_confidence", "rms_db", "clipping_detected", "centroid", "flatness", F.array_join("errors", ",").alias("errors"))


@query("spectral_bundle", SIG, FR, PW, SPEC, MELW, MFCC, "z AS (SELECT clip_id, avg(CASE WHEN (x >= 0) <> (prev >= 0) THEN 1.0 ELSE 0 END) AS zcr FROM (SELECT clip_id, x, lag(x) OVER (PARTITION BY clip_id ORDER BY n) AS prev FROM signal) WHERE prev IS NOT NULL GROUP BY clip_id)", select="SELECT clip_id, round(centroid, 4) AS centroid, round(flatness, 4) AS flatness, round(zcr, 6) AS zcr, (SELECT round(avg(x), 6) FROM mc WHERE mc.clip_id = m.clip_id AND c = 2) AS third FROM m JOIN z USING (clip_id)")
def spectral_bundle(spark, sf):
    b = T.spectral_bundle(_blocks(spark, sf), RATE, SIZE, N_FFT, HOP, BANDS, COEFFICIENTS)
    return b.select("clip_id", F.round("centroid", 4).alias("centroid"), F.round("flatness", 4).alias("flatness"), F.round("zcr", 6).alias("zcr"), F.round(F.col("mfcc")[2], 6).alias("third"))


@query("embed_missing", SIG, LEN, FR, PW, SPEC, *WIDE, EIGHTHS, FR8, PW8, QUALITY, VECTOR, V.SAMPLES, "nv AS (SELECT clip_id, CAST(i AS INT) AS i, round(v / sqrt(sum(v * v) OVER (PARTITION BY clip_id)), 6) AS x FROM va)", select="SELECT id, CAST(CASE WHEN id % 3 = 0 THEN 1 WHEN i IS NOT NULL THEN 2 END AS INT) AS version, i, x FROM samples LEFT JOIN nv ON clip_id = id AND id % 3 <> 0")
def embed_missing(spark, sf):
    """All samples after missing vectors are made: every third clip has one (empty here), clips with sound get theirs, the rest have NULLs."""
    s = V.samples(spark, sf)
    have = s.where("id % 3 = 0").select("id", F.array().cast("array<double>").alias("v"), F.lit(1).alias("version"))
    e, failed = T.embed_missing(s, have, _blocks(spark, sf), RATE, 2, SIZE, N_FFT, HOP, 32)
    every = e.select("id", "v", "version").unionByName(failed.select("id", F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("int").alias("version")))
    return every.select("id", "version", F.posexplode_outer("v").alias("i", "x")).select("id", "version", "i", F.round("x", 6).alias("x"))


@query("split_job", SIG, LEN, V.SAMPLES, V.TAGS, FNV_OF.format("samples"), "g AS (SELECT clip_id, len, CAST(ceil(len / 349) AS BIGINT) AS n, unnest(range(0, CAST(ceil(len / 349) AS BIGINT), 6)) AS i FROM len)",
    f"c AS (SELECT g.clip_id, regexp_extract(path, '^(.*/)') || {text.ADJECTIVES}[CAST(h % 12 AS INT) + 1] || '-' || {text.NOUNS}[CAST((h // 65536) % 12 AS INT) + 1] || '_' || lpad(CAST(i // 6 + 1 AS VARCHAR), 3, '0') || '.wav' AS path FROM g JOIN samples s ON s.id = g.clip_id JOIN h ON h.id = s.id)",
    "n AS (SELECT *, (SELECT max(id) FROM samples) + row_number() OVER (ORDER BY path) AS id FROM c)", select="SELECT id AS sample_id, 'parent:' || clip_id AS tag FROM n UNION SELECT id, 'split' FROM n UNION SELECT n.id, min(t.tag) FROM n JOIN sample_tag t ON t.sample_id = n.clip_id AND t.tag LIKE 'session:%' GROUP BY n.id")
def split_job(spark, sf):
    """Tags of the clips that a split of the first ten clips on a beat grid makes."""
    parts = T.beat_chunks(S.lengths(_blocks(spark, sf)), F.lit(110.0), RATE, 2, 3)
    s, t = V.samples(spark, sf).select("id", "path", "pack_id", "source_type", "duration"), V.sample_tag(spark, sf)
    new, tags = M.split_clips(s, t, parts, RATE)
    return tags.join(new.join(s.select("id"), "id", "left_anti").select(F.col("id").alias("sample_id")), "sample_id", "left_semi")


WHOLE = SIG.replace("signal AS", "whole AS", 1)


@query("naming_features", WHOLE, "signal AS (SELECT * FROM whole WHERE n < 1920)", FR, PW, SPEC, ENV, LAGS, TEMPO, "lv AS (SELECT clip_id, sqrt(avg(x * x)) AS rms FROM signal GROUP BY ALL), zc AS (SELECT clip_id, avg(CASE WHEN (x >= 0) <> (prev >= 0) THEN 1.0 ELSE 0 END) AS zcr FROM (SELECT clip_id, x, lag(x) OVER (PARTITION BY clip_id ORDER BY n) AS prev FROM signal) WHERE prev IS NOT NULL GROUP BY clip_id)",
    select="SELECT clip_id, round(rms, 6) AS rms, round(centroid, 6) AS centroid, round(zcr, 6) AS zcr, round((SELECT count(*) FROM whole WHERE whole.clip_id = m.clip_id) / 640, 6) AS dur_s, bpm AS tempo FROM m JOIN tb USING (clip_id) JOIN lv USING (clip_id) JOIN zc USING (clip_id)")
def naming_features(spark, sf):
    return six(T.naming_features(_blocks(spark, sf), RATE, SIZE, 3.0, N_FFT, HOP), "rms", "centroid", "zcr", "dur_s", "tempo")


RING = """rg AS (SELECT clip_id, n - (len - 256) AS i, x FROM signal JOIN len USING (clip_id) WHERE n >= len - 256), rd AS (SELECT clip_id, k, sqrt(power(sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 255)) * cos(2 * pi() * k * i / 256)), 2) + power(sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 255)) * sin(2 * pi() * k * i / 256)), 2)) / 256 AS a FROM rg, (SELECT unnest(range(0, 128)) AS k) GROUP BY ALL),
rb AS (SELECT b AS bin, CAST(floor(power(b / 16, 2) * 128) AS BIGINT) AS lo, greatest(CAST(floor(power((b + 1) / 16, 2) * 128) AS BIGINT), CAST(floor(power(b / 16, 2) * 128) AS BIGINT) + 1) AS hi FROM (SELECT unnest(range(0, 16)) AS b))"""


@query("ring_spectrum", SIG, LEN, RING, select="SELECT clip_id, CAST(bin AS INT) AS bin, round(max(a), 6) AS x FROM rd JOIN rb ON k >= lo AND k < hi GROUP BY ALL")
def ring_spectrum(spark, sf):
    """The latest 256 samples of each clip and their display spectrum."""
    last = T.edges(_blocks(spark, sf), F.least(F.lit(256).cast("long"), F.col("len")), SIZE).select("clip_id", "tail")
    s = T.per_array(last, "tail", lambda x: T.log_spectrum(x, 16), "bins", "array<double>")
    return s.select("clip_id", F.posexplode("bins").alias("bin", "x")).select("clip_id", "bin", F.round("x", 6).alias("x"))
