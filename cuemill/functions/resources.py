"""Codes, versions and resource budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language names that stand for a code, and GB of memory a speech model takes.
LANGUAGES = {"spanish": "es", "es-es": "es", "english": "en", "en-gb": "en", "en-us": "en"}
VOICES = {"en-us": "en-us", "en": "en-us", "es-es": "es", "es": "es", "fr-fr": "fr-fr", "fr": "fr-fr", "de-de": "de", "de": "de", "it-it": "it", "it": "it", "pt-br": "pt-br", "ja": "ja", "zh": "zh"}
GPU_MODEL_GB, OTHER_MODEL_GB, GPU_SHARE, LEAST_GPU_GB, LEAST_GB, SYSTEM_GB, CUDA_GB = 1.5, 3.0, 0.85, 2.0, 0.5, 2.0, 3.0
MODEL_GB = {"tiny": 0.8, "base": 1.0, "small": 1.6, "medium": 3.0, "large": 5.5, "large-v3": 5.5}


def lookup(table: dict, key: Column, default: Column) -> Column:
    out = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(out, key), default)


def language_code(c: Column) -> Column:
    """The primary code of a language name or tag."""
    name = F.lower(F.trim(c))
    return lookup(LANGUAGES, name, F.split_part(name, F.lit("-"), F.lit(1)))


def voice_code(c: Column) -> Column:
    name = F.trim(F.replace(F.lower(c), F.lit("_"), F.lit("-")))
    return lookup(VOICES, name, name)


def version_tuple(c: Column) -> Column:
    """The leading numbers of a version, digits of each part; a part without digits ends it."""
    digits = F.transform(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("-"), F.lit(".")), r"\."), lambda p: F.regexp_replace(p, "[^0-9]", ""))
    end = F.array_position(digits, "")
    return F.transform(F.when(end > 0, F.slice(digits, F.lit(1), (end - 1).cast("int"))).otherwise(digits), lambda d: d.cast("long"))


def gpu_memory(shared: Column, free: Column, available: Column) -> Column:
    return F.greatest(F.lit(0.0), F.when(shared, available - SYSTEM_GB).otherwise(free))


def whisper_device(requested: Column, usable: Column, gpu_gb: Column) -> Column:
    """cuda or cpu; null where cuda is asked for and can't be had, or nothing known is asked for."""
    ask, fits = F.lower(F.trim(requested)), usable & (gpu_gb >= CUDA_GB)
    return F.when(ask == "cuda", F.when(fits, "cuda")).when(ask == "cpu", "cpu").when(ask == "auto", F.when(fits, "cuda").otherwise("cpu"))


def whisper_compute(requested: Column, device: Column) -> Column:
    ask = F.lower(F.trim(requested))
    ask = F.when(ask == "auto", F.when(device == "cuda", "float16").otherwise("int8")).otherwise(ask)
    ok = F.when(device == "cuda", ask.isin("float16", "int8_float16", "int8_float32", "float32")).otherwise(ask.isin("int8", "int8_float32", "float32"))
    return F.when(ok, ask).otherwise(F.when(device == "cuda", "float16").otherwise("int8"))


def safe_parallelism(cpus: Column, available_gb: Column, gpu_gb: Column, device: Column, model: Column, threads: Column, requested: Column) -> Column:
    """How many media to work on at once: the least of what processors, memory and the GPU hold, at most what is asked for (0: all)."""
    t = F.when(threads > 0, threads).otherwise(F.greatest(F.lit(2), F.least(F.lit(8), F.floor(cpus / 2)))).cast("long")
    ram = lookup(MODEL_GB, F.lower(model), F.lit(OTHER_MODEL_GB))
    on_gpu = device == "cuda"
    by_cpu = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), cpus - 2) / F.greatest(F.lit(1), t)))
    need = F.when(on_gpu, F.lit(GPU_MODEL_GB)).otherwise(ram)
    by_ram = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1.0), available_gb - SYSTEM_GB) / F.greatest(F.lit(LEAST_GB), need)))
    by_gpu = F.when(on_gpu, F.greatest(F.lit(1), F.floor(gpu_gb / F.greatest(F.lit(LEAST_GB), F.greatest(F.lit(LEAST_GPU_GB), ram * GPU_SHARE))))).otherwise(F.lit(2**31 - 1))
    cap = F.greatest(F.lit(1), F.least(by_cpu, by_ram, by_gpu))
    return F.when(requested <= 0, cap).otherwise(F.least(F.greatest(F.lit(1), requested), cap)).cast("long")


def profile(memory_gb: Column, cpus: Column) -> Column:
    """The tier of a machine: name, translation batch and default threads."""
    tier = lambda name, batch, threads: F.struct(F.lit(name).alias("name"), F.lit(batch).alias("batch"), threads.cast("int").alias("threads"))
    half = F.floor(cpus / 2)
    high, middle = (memory_gb >= 24) & (cpus >= 12), (memory_gb >= 14) & (cpus >= 6)
    return (
        F.when(high, tier("high", 12, F.least(F.lit(8), F.greatest(F.lit(4), half))))
        .when(middle, tier("balanced", 10, F.least(F.lit(6), F.greatest(F.lit(3), half))))
        .otherwise(tier("low", 6, F.least(F.lit(4), F.greatest(F.lit(2), cpus - 1))))
    )


def default_model(requested: Column, device: Column, gpu_gb: Column, memory_gb: Column, cpus: Column) -> Column:
    ask = F.lower(requested)
    roomy = ((device == "cuda") & (gpu_gb >= 8)) | ((memory_gb >= 16) & (cpus >= 6))
    return F.when(ask == "auto", F.when(roomy, "medium").otherwise("small")).otherwise(ask)
