"""Boundary cases of the operators that the tables don't hold."""

import math
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cuemill.functions import media, names, quality, resources, text, times, uris
from cuemill.operators import archives, candidates, cues, dedup, fallback, intervals, listings, similarity, state, timeline


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_words_and_folding(spark):
    got = one(spark, text.words(F.col("t")), t="L'été’s well-known – 3,5 _x_ ’a' ß")
    assert got == ["L'été’s", "well-known", "3", "5", "_x_", "a", "ß"]
    assert one(spark, text.casefold(F.col("t")), t="Straße") == "strasse"
    assert one(spark, text.strip_marks(F.col("t")), t="Ünï ñ é") == "Uni n e"


def test_metrics_of_short_and_looping_texts(spark):
    m = lambda t: one(spark, quality.metrics(F.col("t")), t=t)
    assert m("").word_count == 0 and m("").repetition == 0
    assert m("one").bigram_ratio == 0 and m("one").dominant_ratio == 1
    loop = m("go on " * 6)
    assert math.isclose(loop.bigram_ratio, 9 / 11) and math.isclose(loop.trigram_ratio, 8 / 10)


def test_reasons(spark):
    rows = [(8, 0.6, None, None, 0.9), (7, 0.9, None, None, 0.9), (9, 0.1, 2.4, -1.0, 0.9), (9, 0.1, 2.5, -1.1, 0.6), (0, 0.0, None, None, None)]
    df = spark.createDataFrame(rows, "word_count long, repetition double, compression_ratio double, avg_logprob double, no_speech_prob double")
    assert [r.x for r in df.select(quality.reasons().alias("x")).collect()] == [["repetition", "no_speech"], [], [], ["compression", "low_logprob"], ["empty"]]


def test_recovery(spark):
    rows = [(1, 0, 0, 0, "fine words here"), (2, 0, 0, 0, ""), (2, 1, 0, 0, ""), (2, 1, 1, 0, "good"), (2, 2, 0, 0, "better later"), (3, 0, 0, 0, ""), (3, 1, 0, 0, "")]
    df = spark.createDataFrame(rows, "segment_id int, round int, pass int, pos int, text string")
    for c in ("compression_ratio", "avg_logprob", "no_speech_prob"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    got = {r.segment_id: (r.text, r.accepted) for r in candidates.recovered(candidates.with_quality(df)).collect()}
    assert got == {1: ("fine words here", True), 2: ("good", True), 3: ("", False)}


def segments(spark, rows):
    return spark.createDataFrame([(1, k, float(a), float(b), t) for k, (a, b, t) in enumerate(rows)], "media_id int, seq int, start double, end double, text string")


def test_gaps(spark):
    df = segments(spark, [(0, 10, "a"), (1, 2, "b"), (5, 6, "c"), (12, 13, "d"), (13.5, math.nan, "x"), (14, 14, "y"), (14.0, 15, " ")])
    got = [(r.start, r.end, r.text) for r in intervals.gap_segments(df, 1.0).orderBy("start").collect()]
    assert got == [(0.0, 2.0, "ab"), (5.0, 6.0, "c"), (12.0, 15.0, "d")]
    assert intervals.gap_segments(df.limit(0)).count() == 0


def test_interval_policies(spark):
    df = segments(spark, [(0, 0, "a"), (5, 4, ""), (3, 20, "b"), (4, 6, "c")])
    assert [r.valid for r in intervals.strict(df).orderBy("seq").collect()] == [False, False, True, True]
    assert intervals.lenient(df).first().asDict() == {"media_id": 1, "fault": "end before start", "n_empty": 1, "n_cues": 4}
    assert [r.faults for r in intervals.all_faults(df).orderBy("seq").collect()] == [[], ["end before start"], ["unordered"], []]
    assert intervals.speech(df).first().fault == "invalid time"
    r = intervals.regenerated(df).first()
    assert (r.n_unordered, r.n_overlap, r.valid) == (1, 1, False)


def test_edits_and_review(spark):
    edits = [(0, 1, "J"), (2, 3, "YY"), (4, 1, "overlaps"), (50, 1, "far"), (1, 1, "")]
    df = spark.createDataFrame([("hello", edits)], "t string, e array<struct<offset: int, length: int, value: string>>")
    assert df.select(text.apply_edits(F.col("t"), F.col("e")).alias("x")).first().x == "Jelloverlaps"
    c = spark.createDataFrame([(1, 1, "abc"), (1, 2, "def")], "media_id int, index int, text string")
    review = lambda d: d.filter("index = 1").select("media_id", "index", F.expr("array(named_struct('offset', 0, 'length', 1, 'value', 'X'))").alias("edits"), F.lit(3.0).alias("confidence"))
    out, issues = cues.reviewed(c, [("a", review), ("b", review)])
    assert {r["index"]: r.text for r in out.collect()} == {1: "Xbc", 2: "def"}
    assert [(r.engine, r.before, r.after, r.confidence) for r in issues.collect()] == [("a", "abc", "Xbc", 1.0)]


def test_dedup_decisions(spark):
    f = spark.createDataFrame([("12x03_a", "s"), ("wetransfer_b", "s"), ("x1", "t"), ("x2", "t"), ("alone", "u")], "name string, signature string")
    got = {r.signature: (r.canonical, r.decision) for r in dedup.decisions(f).collect()}
    assert got == {"s": ("12x03_a", "delete_duplicates"), "t": ("x1", "keep")}
    plan = dedup.plan(f, dedup.decisions(f))
    assert [r.duplicate for r in plan.collect()] == ["wetransfer_b"]
    assert dedup.checked(plan, f).first().refusal is None
    assert dedup.checked(plan, f.filter("name <> '12x03_a'")).first().refusal == "canonical is gone"


def test_fallback_provider_calls(spark):
    assert fallback.called(lambda t: [x.upper() for x in t], ["a", "b"]) == (["A", "B"], None)
    assert fallback.called(lambda t: [], ["a"]) == ([None], "0 results for 1 texts")
    calls = []

    def flaky(texts):
        calls.append(1)
        raise OSError("down")

    assert fallback.called(flaky, ["a"], attempts=9)[0] == [None] and len(calls) == 3
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(60)], "seq int, text string")

    def halves(texts):
        return [t if int(t[1:]) % 2 else " " for t in texts]

    out = fallback.passes(rows, [("half", fallback.provider_step(halves)), ("rest", fallback.provider_step(lambda t: [x + "!" for x in t]))]).collect()
    assert {r.provider for r in out} == {"half", "rest"} and all(r.translated == (f"t{r.seq}" if r.seq % 2 else f"t{r.seq}!") for r in out)


def test_quota_refusals_take_nothing(spark):
    rows = [("deepl", "2024-01", k, n, 10) for k, n in enumerate([6, 5, 4, 1])] + [("free", None, 9, 99, None)]
    got = {r.req_id: (r.accepted, r.used) for r in fallback.reserved(spark.createDataFrame(rows, "provider string, window string, req_id int, amount long, limit long")).collect()}
    assert got == {0: (True, 6), 1: (False, 6), 2: (True, 10), 3: (False, 10), 9: (True, None)}


def test_names(spark):
    assert one(spark, names.clean_name(F.col("t")), t=" Ñandú – Café™ (2)! ") == "nandu_cafe_2"
    assert one(spark, names.strip_dates(F.col("t")), t="a 2024-01-05T10:11:12Z b 123456789 c 12345") == "a _ b 123456789 c 12345"
    assert one(spark, names.is_reserved(F.col("t")), t="LPT1.tar.gz") and not one(spark, names.is_reserved(F.col("t")), t="LPT0")
    assert one(spark, names.truncate_bytes(F.col("t"), 4), t="aéé") == "aé"
    assert one(spark, names.fit_component(F.col("t"), 8, "x1"), t="abcdefgh") == "abcde_x1"
    assert one(spark, names.comparison_key(F.col("t")), t="wetransfer_My Talk 2024-01-05 (copy).mp4") == "my talk"
    s = one(spark, names.name_similarity(F.col("a"), F.col("b")), a="red apple pie", b="red apple tart")
    assert math.isclose(s, 0.65 * SequenceMatcher(None, "red apple pie", "red apple tart").ratio() + 0.35 * 2 / 4)
    assert one(spark, names.artifact_stem(F.lit("old_a.VTT"), F.lit("old_a"), F.lit("new"))) == "new.vtt"
    for name in ("niño.wmv", "canción.mp4", "compresio\u0301n.wmv"):
        damaged = name.encode().decode("cp437")
        assert one(spark, names.repaired_member(F.lit(damaged), F.lit(False))) == unicodedata.normalize("NFC", name)
        assert one(spark, names.repaired_member(F.lit(damaged), F.lit(True))) == damaged
    assert one(spark, names.repaired_member(F.lit("pl│in"), F.lit(False))) == "pl│in"
    assert one(spark, names.normal_filename(F.col("t")), t="Leccio\u0301n_niño_2026-08-31.MP4") == "leccion_nino.mp4"
    assert one(spark, names.normal_component(F.col("t")), t="CON") == "_con"
    stem = lambda t, *a: one(spark, names.fit_stem(F.col("t"), *a), t=t)
    assert stem("Curso-03: Niño / CON?") == "curso_03_nino_con" and stem("CON") == "_con" and stem("19x2-POSTURAS (FIJAS)") == "19x2_posturas_fijas"
    assert stem("x" * 300, 20, "ab12cd34") == "x" * 9 + "___ab12cd34" and stem("ab cd ef", 19, "", ["_original.vtt"]) == "ab_cd" and stem("?", 20) == "_"
    assert one(spark, names.path_fits(F.col("t"), 5, 12), t="abc/éé/x") and not one(spark, names.path_fits(F.col("t"), 5, 12), t="abc/ééé/x")
    assert not one(spark, names.path_fits(F.col("t"), 5, 6), t="abc/é/x")
    assert one(spark, names.safe_directory(F.lit('a<b>:".zip. '))) == "a_b___.zip"


#: Archive, file and stem of transfers.
TRANSFERS = [
    ("wetransfer_7o-opt-taich-bombeos-mp4_2026-07-20_1135__f0232f8d88590c18", "8º OPT TAICH pendulos, abanicos, lanzamientos.mp4", "7_opt_taich_bombeosx8_opt_taich_pendulos_abanicos_lanzamientos"),
    ("wetransfer_curso19-basic_2026-07-19_0916__d140128160f88ce8", "5.-posturas fijas del taichi desde 0.mp4", "19x5_posturas_fijas_del_taichi_desde_0"),
    ("wetransfer_curso35_2026-07-19_1416__083e19a07cf5f284", "17.mp4", "35x17"),
    ("wetransfer_curso37_1o-optimizadores-de-taichi-mp4_2026-07-19_2215__adae04e1", "5ºoptim taich  MANOS COMO NUBES.mp4", "37_1_optimizadores_de_taichix5_optim_taich_manos_como_nubes"),
    ("wetransfer_estas-son-promocinales-son-6_2026-07-28_1039__0c10ca636f4c4fc2", "TAICHI CHINNA (Cuello de dragón)2º parte.mp4", "estas_son_promocinales_son_6xtaichi_chinna_cuello_de_dragon_2_parte"),
    ("wetransfer_6-boxeo-sombras-filo-wmv_2026-07-27_1138__89de9eb473373033", "10. BOXEO SOMBRAS variaciones.wmv", "6_boxeo_sombras_filox10_boxeo_sombras_variaciones"),
]
#: Path, course, its words, lesson, its words, stem.
LESSONS = [
    ("Curso_03/07_Forma_del_Tigre.mp4", 3, None, 7, "forma_del_tigre", "3x07_forma_del_tigre"),
    ("Taichi_Intermedio/Respiracion_y_movimiento.mp4", None, "taichi_intermedio", None, "respiracion_y_movimiento", "taichi_intermedioxrespiracion_y_movimiento"),
    ("Respiracion_y_movimiento.mp4", None, None, None, "respiracion_y_movimiento", "respiracion_y_movimiento"),
    ("download_26/08/2026 12:00:00_Curso_03/07_Forma_del_Tigre.mp4", 3, None, 7, "forma_del_tigre", "3x07_forma_del_tigre"),
    ("download_2026.08.26T12:00:00_Curso_03/07_Forma_del_Tigre.mp4", 3, None, 7, "forma_del_tigre", "3x07_forma_del_tigre"),
    ("Taichi_Intermedio/02_Forma.mp4", None, "taichi_intermedio", 2, "forma", "taichi_intermediox02_forma"),
    ("Curso_03/Forma_del_Tigre.mp4", 3, None, None, "forma_del_tigre", "3xforma_del_tigre"),
    ("Curso 12 movilidad articular/Leccion 3 rotacion de hombros.mp4", 12, "movilidad_articular", 3, "rotacion_de_hombros", "12_movilidad_articularx03_rotacion_de_hombros"),
    ("Curso movilidad articular/2 - rotacion de hombros.mp4", None, "movilidad_articular", 2, "rotacion_de_hombros", "movilidad_articularx02_rotacion_de_hombros"),
    ("wetransfer_material-estudio/saludo-inicial.mp4", None, "material_estudio", None, "saludo_inicial", "material_estudioxsaludo_inicial"),
    ("Curso 03 Tai Chi/07 Forma del Tigre_31/08/2026 10:24:59.mp4", 3, "tai_chi", 7, "forma_del_tigre", "3_tai_chix07_forma_del_tigre"),
    ("12º curso historia/3º intro.mp4", None, "12º_historia", 3, "º_intro", "12º_historiax03_º_intro"),
    ("Curso 12 Dibujo/03. La línea.mp4", 12, "dibujo", 3, "la_linea", "12_dibujox03_la_linea"),
    ("Curso 2/Tema 4/.mp4", 2, None, 4, None, "2x04"),
]


def test_course_and_lesson_of_paths(spark):
    paths = [p for p, *_ in LESSONS] + [f"{a}/{b}" for a, b, _ in TRANSFERS]
    got = {r.p: r.c for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", names.course_lesson(F.col("p")).alias("c")).collect()}
    for path, *want in LESSONS[:-1]:
        c = got[path]
        assert [c.course, c.course_name, c.lesson, c.lesson_name, c.output_stem] == want, path
        assert c.review_required == (None in (c.course, c.lesson)) and c.confidence == ("medium" if c.review_required else "high")
    assert (got[LESSONS[-1][0]].course, got[LESSONS[-1][0]].review_reason) in ((2, ""), (2, names.NO_LESSON))
    for archive, leaf, stem in TRANSFERS:
        assert got[f"{archive}/{leaf}"].output_stem == stem
    assert one(spark, names.reference_stem(F.lit("wetransfer_curso19_2026-07-19.zip"), F.lit("6.-X.mp4"))) == "19x6_x"


def test_a_path_is_read_once(spark):
    """What is used twice is bound: the expression stays short, and thousands of paths take seconds."""
    df = spark.createDataFrame([(f"Curso {i % 40} abc/0{i % 9}. Lección {i}.mp4",) for i in range(5000)], "p string")
    got = df.select("p", names.course_lesson(F.col("p")).alias("c"))
    assert got._jdf.queryExecution().analyzed().toString().count("regexp_replace(") < 200
    rows = got.collect()
    assert len(rows) == 5000
    assert all(r.c.output_stem == f"{int(r.p[6:8])}_abcx{i % 9:02d}_{i}" for i, r in enumerate(rows))


def test_stems_of_transfers_are_dealt(spark):
    """One file of parts is worked on by all cores."""
    from cuemill.plans import catalogue

    for name in ("archive_stems", "course_lessons"):
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_languages_and_keys(spark):
    cases = {"my_tv.vtt": ("my_tv", None), "talk_es-es.vtt": ("talk", "es-es"), "a_en-us.vtt": ("a", "en-us"), "dir/talk.ES.vtt": ("talk", "es"), "talk_es": ("talk_es", None), ".es": (".es", None), "x": ("x", None)}
    for name, (stem, language) in cases.items():
        r = one(spark, names.language_suffix(F.col("t")), t=name)
        assert (r.stem, r.language) == (stem, language), name
    assert one(spark, names.subtitle_name(F.lit("talk_es.mp4"), F.lit("EN"))) == "talk_en.vtt"
    keys = {"video_03_forma_del_tigre.mp4": "03 forma del tigre", "zip - talk one.mp4": "talk one", "drive-download-x.mp4": "drive x", "files from Ana talk.mp4": "ana talk", "unzipped_a-copy.mov": "a", "": ""}
    for name, key in keys.items():
        assert one(spark, names.comparison_key(F.col("t")), t=name) == key, name


def test_pairs_of_names_by_brute_force(spark):
    import random

    r = random.Random(4)
    words = "red green blue apple pear plum talk part one two".split()
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 5)))) for k in range(60)] + [(60, ""), (61, "")]
    df = spark.createDataFrame(rows, "id int, key string")

    def plain(a, b):
        if not a or not b:
            return float(a == b)
        x, y = set(a.split()), set(b.split())
        return 0.65 * SequenceMatcher(None, a, b).ratio() + 0.35 * len(x & y) / len(x | y)

    rows += [(70, "nnoy tocs"), (71, "tocs ynno"), (72, "zz"), (73, "zzz zzzz zz"), (74, "😀 né 😀a"), (75, "é😀 n😀 a"), (76, "a" * 40), (77, "a" * 13)]
    df = spark.createDataFrame([*rows, (99, None)], "id int, key string")
    for threshold, tile in ((0.1, 2048), (0.5, 7), (0.65, 2048), (0.7, 3), (0.82, 2048)):
        want = {(i, j) for i, a in rows for j, b in rows if plain(a, b) >= threshold}
        assert {(x.left_id, x.right_id) for x in similarity.name_pairs(df, df, threshold, tile).collect()} == want, threshold
    with pytest.raises(ValueError, match="every pair"):
        similarity.name_pairs(df, df, 0.0)


def test_a_word_of_all_names_is_met_in_tiles(spark):
    df = spark.range(300).selectExpr("id", "concat('talk n', id) as key")
    on = spark.range(300).selectExpr("id as left_id", "'talk' as _w"), spark.range(200).selectExpr("id as right_id", "'talk' as _w")
    met = similarity._tiled(*on, ["_w"], 50)
    sizes = [r["count"] for r in met.groupBy("_i", "_j").count().collect()]
    assert met.count() == 60_000 and len(sizes) == 24 and max(sizes) < 5000
    assert similarity.name_pairs(df, df, 0.99, 20).count() == 300


def test_listings(spark):
    rows = [("B", None, "x.mkv"), ("a", "original_transcriptions", "t.VTT"), ("c", None, "t.vtt"), ("d", "original_transcriptions", "t.bak.vtt"), ("e", None, "v_TTS.mp4"), ("_manifests", None, "m.mp4")]
    files = spark.createDataFrame(rows, "folder string, subfolder string, name string")
    assert [r.folder for r in listings.eligible_folders(files).collect()] == ["a", "B", "e"]
    assert {r.folder for r in listings.video_choice(files).collect()} == {"B", "_manifests"}
    assert [r.folder for r in similarity.first_of(spark.createDataFrame([("f", 2), ("f", 1), ("g", 3)], "folder string, pos int"), "folder", ["pos"]).collect()] == ["f", "g"]
    assert [r.source for r in similarity.by_source(spark.createDataFrame([("b",), (None,), ("a",)], "source string")).collect()] == [None, "a", "b"]


def test_synthesised_speech(spark):
    def speak(text, language, voice, speed):
        return [2.0, -1.0] * len(text), 50

    rows = [(1, "ab", "en", "v", 1.0), (2, "  ", "en", "v", 1.0)]
    got = {r.seq: r for r in timeline.synthesised(spark.createDataFrame(rows, "seq int, text string, language string, voice string, speed double"), speak, 100).collect()}
    assert got[1].n_samples == 8 and got[1].audio[0] == 1.0 and max(map(abs, got[1].audio)) == 1.0 and got[2].audio == []


def test_medium_valid(spark):
    rows = [(1, 1, 0.0, 1.0, "a"), (2, 1, 5.0, 2.0, "a")]
    out = intervals.medium_valid(spark.createDataFrame(rows, "media_id int, seq int, start double, end double, text string"))
    assert {r.media_id: r.valid for r in out.collect()} == {1: True, 2: False}


def test_addresses_and_members(spark):
    assert one(spark, uris.parse_uri(F.col("t")), t="local:///a%20b") == ("local", "/a b", "local")
    assert one(spark, uris.parse_uri(F.col("t")), t="ftp://x") is None
    assert one(spark, uris.scheme_fits(F.col("t"), F.lit("local")), t="ftp://x") is False
    faults = {n: one(spark, uris.member_fault(F.col("t")), t=n) for n in ("a/b", "../a", "C:/x", "a\\..\\b", "x/CON.txt", "\\\\srv\\x")}
    assert faults == {"a/b": None, "../a": "parent", "C:/x": "absolute", "a\\..\\b": "parent", "x/CON.txt": "reserved", "\\\\srv\\x": "absolute"}
    assert one(spark, uris.safe_profile(F.lit("../x"))) is False


def test_times(spark):
    assert one(spark, times.format_time(F.lit(59.9996))) == "00:01:00.000"
    assert one(spark, times.format_time(F.lit(59.9996), carry=False)) == "00:00:60.000"
    assert one(spark, times.format_time(F.lit(-1.0))) is None
    assert one(spark, times.parse_time(F.lit("01:02:03,500"))) == 3723.5 and one(spark, times.parse_time(F.lit("02:03"))) is None
    assert one(spark, times.sample_positions(F.lit(0.0))) == [0.0]
    assert one(spark, times.stretch_factors(F.lit(3.0))) == [2.0, 1.5] and one(spark, times.stretch_factors(F.lit(2.0))) == [2.0]


def test_media(spark):
    h = media.average_hash(F.array(*[F.lit(x) for x in (0, 255, 255, 0)]))
    assert one(spark, h) == (0.5, "0110")
    assert one(spark, media.visual_similarity(F.array(h), F.array(h))) == 1.0
    assert one(spark, media.visual_similarity(F.array(h), F.array(h, h))) == 0.0
    assert one(spark, media.audio_features(F.array(F.lit(0.5), F.lit(-0.5)))) == (0.5, 0.5, 0.5)
    assert one(spark, media.resampled(F.array(F.lit(0.0), F.lit(1.0)), F.lit(2), F.lit(4)))[:3] == [0.0, 0.5, 1.0]
    assert one(spark, media.peak_normalised(F.array(F.lit(2.0), F.lit(-1.0)))) == [1.0, -0.5]


def test_duplicate_media(spark):
    i = F.struct(F.lit(60.0).alias("duration_seconds"), F.lit(4).alias("width"), F.lit(3).alias("height"), F.lit("video").alias("media_type"), F.array(media.average_hash(F.array(F.lit(1), F.lit(9)))).alias("video_samples"), F.array(media.audio_features(F.array(F.lit(0.5), F.lit(-0.5)))).alias("audio_samples"), F.lit(2).alias("audio_channels"), F.lit(48000).alias("audio_sample_rate"))
    m = spark.createDataFrame([(1, "h1", "red apple pie"), (2, "hx", "red apple pie"), (3, "hy", "something else")], "id int, sha256 string, key string").withColumn("identity", i)
    r = spark.createDataFrame([(7, "h1", "other", "f"), (8, "h2", "red apple pie", "f"), (9, "h1", "z", "")], "pos int, sha256 string, key string, output_folder string").withColumn("identity", i)
    got = {x.id: (x.pos, x.status) for x in similarity.cascade(m, r).collect()}
    assert got == {1: (7, "duplicate_exact"), 2: (8, "duplicate_probable")}


def test_resources(spark):
    assert one(spark, resources.version_tuple(F.lit("12.4-rc1.x.9"))) == [12, 4, 1]
    assert one(spark, resources.version_tuple(F.lit(None).cast("string"))) == []
    assert one(spark, resources.language_code(F.lit(" EN-GB "))) == "en" and one(spark, resources.language_code(F.lit("pt-BR"))) == "pt"
    assert one(spark, resources.whisper_device(F.lit("cuda"), F.lit(False), F.lit(9.0))) is None
    assert one(spark, resources.safe_parallelism(F.lit(16), F.lit(32.0), F.lit(0.0), F.lit("cpu"), F.lit("small"), F.lit(4), F.lit(2))) == 2


def test_state(spark):
    s = spark.createDataFrame([("a",), ("b",)], "source string")
    m = spark.createDataFrame([("a", 1, "success", "f1"), ("a", 2, "success", "f2"), ("b", 3, "error", "f3")], "source string, pos int, status string, output_folder string")
    assert {r.source: (r.output_folder, r.resumed) for r in state.resume_split(s, m).collect()} == {"a": ("f2", True), "b": (None, False)}
    rows = spark.createDataFrame([("x", "1", "aaaaaaaaa"), ("x", "2", "aaaaaaaaa"), ("x", "3", "aaaaaaaaa"), ("y", "4", "b" * 9)], "stem string, source string, sha256 string")
    got = {r.source: r.output_stem for r in state.unique_stems(rows, spark.createDataFrame([("y",)], "stem string")).collect()}
    assert got == {"1": "x", "2": "x___aaaaaaaa", "3": "x___aaaaaaaa_02", "4": "y___bbbbbbbb"}


def test_videos_in_the_order_of_listings(spark):
    files = spark.createDataFrame([("f", "B.mp4"), ("f", "a.mp4"), ("f", "0.mkv"), ("g", "b.avi"), ("g", "A.mkv"), ("h", "x.MP4"), ("h", "X.mp4")], "folder string, name string")
    assert {(r.folder, r.name) for r in listings.video_choice(files).collect()} == {("f", "a.mp4"), ("g", "A.mkv"), ("h", "X.mp4")}


def test_passes_ask_for_each_text_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def provider(texts):
        asked.add(len(texts))
        return [t if t in ("a", "b") else "" for t in texts]

    rows = spark.createDataFrame([(k, t) for k, t in enumerate("abcd")], "seq int, text string")
    ask = fallback.provider_step(provider)
    got = fallback.passes(rows, [("one", ask), ("two", ask), ("three", ask)])
    assert asked.value == 4 + 2 + 2
    assert got.count() == 4 and {(r.seq, r.provider, r.failed) for r in got.collect()} == {(0, "one", False), (1, "one", False), (2, None, True), (3, None, True)}
    assert asked.value == 8


def test_unique_stems_of_nulls(spark):
    rows = [(None, "1", None), (None, "2", None), ("", "3", "abc"), ("x", "4", None), ("x", "5", None)]
    df = spark.createDataFrame(rows, "stem string, source string, sha256 string")
    got = {x.source: x.output_stem for x in state.unique_stems(df).collect()}
    assert got == {"1": "", "2": "___", "3": "___abc", "4": "x", "5": "x___"}
    assert state.unique_stems(df.limit(0)).count() == 0


def plain_stems(rows, taken, fit=None):
    used, out = set(taken), {}
    name = lambda stem, tail: fit(stem, tail) if fit else stem + tail
    for stem, source, digest in sorted(rows, key=lambda r: r[1]):
        got, k = name(stem, ""), 1
        while got in used:
            got, k = name(stem, f"___{digest[:8]}" + (f"_{k:02d}" if k > 1 else "")), k + 1
        used.add(got)
        out[source] = got
    return out


def test_unique_stems_as_one_by_one(spark):
    import random

    r = random.Random(3)
    stems = ["x", "x___aaaaaaaa", "x___aaaaaaaa_02", "y", "y___bbbbbbbb", "x___aaaaaaaa_03___aaaaaaaa"]
    for n in (40, 90):
        rows = [(r.choice(stems), f"{k:03d}", r.choice("ab") * 9) for k in range(n)]
        taken = ["y", "x___bbbbbbbb_03", "x___bbbbbbbb_01", "x___bbbbbbbb_002", "x___bbbbbbbb_3", "x___aaaaaaaa_02", "z"]
        df = spark.createDataFrame(rows, "stem string, source string, sha256 string")
        got = {x.source: x.output_stem for x in state.unique_stems(df, spark.createDataFrame([(t,) for t in taken], "stem string")).collect()}
        assert got == plain_stems(rows, taken) and len(set(got.values())) == n


def test_unique_stems_among_many_taken_numbers(spark, monkeypatch):
    """The jobs do not grow with the numbers that are taken."""
    stored, names = state.stored, []
    monkeypatch.setattr(state, "stored", lambda df, name: names.append(name) or stored(df, name))
    taken = ["x", "x___aaaaaaaa", *(f"x___aaaaaaaa_{k:02d}" for k in range(2, 260) if k % 5)]
    rows = [("x", f"{k:03d}", "a" * 9) for k in range(80)]
    df = spark.createDataFrame(rows, "stem string, source string, sha256 string")
    got = {x.source: x.output_stem for x in state.unique_stems(df, spark.createDataFrame([(t,) for t in taken], "stem string")).collect()}
    assert got == plain_stems(rows, taken)
    assert names.count("stems-named") == 1 and len(names) < 20


def test_unique_stems_that_fit(spark):
    def fit(stem, tail, most=40):
        raw = stem.encode()
        room = most - len(tail.encode())
        if len(raw) > room:
            stem = raw[:room].decode(errors="ignore").rstrip(" ._-")
        return stem + tail or "_"

    long = "lesson_" * 9
    rows = [(s, f"{k:03d}", d * 9) for k, (s, d) in enumerate([(long, "a"), (long + "x", "a"), (long, "a"), (long + "y", "b"), ("short", "a"), ("short", "a"), ("żółw" * 20, "a"), ("żółw" * 21, "a")] * 3)]
    taken = [fit(long, "___aaaaaaaa"), fit(long, "___aaaaaaaa_03")]
    df = spark.createDataFrame(rows, "stem string, source string, sha256 string")
    cleaned = {r.stem: r.c for r in df.select("stem", names.clean_name(F.col("stem")).alias("c")).distinct().collect()}
    got = {x.source: x.output_stem for x in state.unique_stems(df, spark.createDataFrame([(t,) for t in taken], "stem string"), most=40).collect()}
    assert got == plain_stems([(cleaned[s], o, d) for s, o, d in rows], taken, fit)
    assert max(len(x.encode()) for x in got.values()) <= 40 and len(set(got.values())) == len(rows)


def test_timeline(spark):
    rows = [(1, 1, 0.0, 1.0, "a", 100, [0.5] * 100), (1, 2, 2.0, 3.0, "b", 120, [2.0] * 120), (1, 3, 4.0, 5.0, "c", 900, [0.1] * 900), (1, 4, 6.0, 7.0, " ", 0, [])]
    df = spark.createDataFrame(rows, "media_id int, seq int, start double, end double, text string, n_samples long, audio array<double>")
    d = timeline.decided(df, rate=100)
    assert [r.action for r in d.orderBy("seq").collect()] == ["fits", "faster", "stretch", "silence"]
    assert timeline.length(d).first().n_samples == 500
    samples = timeline.rendered(d).first().samples
    assert samples[0] == 0.5 and samples[150] == 0 and samples[200] == 1.0 and len(samples) >= 500


def test_nested_archives(spark, tmp_path):
    import io
    import zipfile

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x.mp4", "video")
        z.writestr("__MACOSX/y", "junk")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("../evil", "e")
    (tmp_path / "b.zip").write_bytes(b"no zip")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = archives.expanded(files).collect()
    assert [(r.name, r.depth, r.pos, r.junk, r.fault) for r in got if r.name] == [
        ("in.zip", 0, 1, False, None), ("../evil", 0, 2, False, "parent"), ("x.mp4", 1, 3, False, None), ("__MACOSX/y", 1, None, True, None)]
    assert [r.error for r in got if r.error]
    # junk counts for nothing: three files are three files
    assert [r.limit for r in archives.expanded(files, most_files=3).collect() if r.limit] == []
    assert [(r.name, r.limit) for r in archives.expanded(files, most_files=2).collect() if r.limit] == [("x.mp4", "files")]
    assert [(r.name, r.depth, r.limit) for r in archives.expanded(files, most_depth=0).collect() if r.limit] == [("in.zip", 0, "depth")]


def test_junk_archives_are_not_opened(spark, tmp_path):
    import io
    import zipfile

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("hidden.mp4", "v")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("__MACOSX/j1", "junk")
        z.writestr("__MACOSX/j2.zip", inner.getvalue())
        z.writestr("v.mp4", "v")
        z.writestr("w.mp4", "w")
    got = archives.expanded(spark.read.format("binaryFile").load(str(tmp_path)), most_files=2).collect()
    assert [(r.name, r.pos, r.limit) for r in got] == [("__MACOSX/j1", None, None), ("__MACOSX/j2.zip", None, None), ("v.mp4", 1, None), ("w.mp4", 2, None)]
