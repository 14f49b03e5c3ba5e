"""What models can do: notes on combinations of engine, model, scale and strength (P12), and the chain of filters that follows.

The catalogue is fixed and small, so it is looked up as a map in the row of a plan, and nothing is joined.
Null scales and strengths match no checkpoint and are in no range, and the texts then say "null".
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinelake.functions.scalar import let

# The engines, the models that each knows, and what those models do.
CUGAN, ESRGAN, WAIFU, ANIME, ANIME_VS = "realcugan-ncnn-vulkan", "realesrgan-ncnn-vulkan", "waifu2x-ncnn-vulkan", "anime4kcpp", "anime4kcpp-vs"
PREFIXES = {CUGAN: "realcugan: ", ESRGAN: "realesrgan: ", WAIFU: "waifu2x: ", ANIME: "anime4kcpp: ", ANIME_VS: "anime4kcpp-vs: "}
CUGAN_PRO = ((2, -1), (2, 0), (2, 3), (3, -1), (3, 0), (3, 3))
CUGAN_OTHER = ((2, -1), (2, 0), (2, 1), (2, 2), (2, 3), (3, -1), (3, 0), (3, 3), (4, -1), (4, 0), (4, 3))
ESRGAN_NATIVE = 4
#: Whether a model is made for moving pictures.
ESRGAN_MODELS = {"realesr-animevideov3": True, "realesrgan-x4plus-anime": False, "realesrgan-x4plus": False}
#: Scales, and whether a model is made for drawings.
WAIFU_MODELS = {"models-cunet": ((1, 2), True), "models-upconv_7_anime_style_art_rgb": ((2,), True), "models-upconv_7_photo": ((2,), False)}
WAIFU_STRENGTHS = -1, 0, 1, 2, 3
ANIME_DEFAULT = "acnet-f8b8-hdn"
ANIME_MODELS = (
    "acnet", "acnet-gan", "acnet-hdn", "acnet-hdn-gan", "acnet-hdn0",
    "acnet-legacy-gan", "acnet-legacy-hdn0", "acnet-legacy-hdn1", "acnet-legacy-hdn2", "acnet-legacy-hdn3",
    "acnet-f8b4", "acnet-f8b4-hdn", "acnet-f8b4-box", "acnet-f8b4-box-hdn",
    "acnet-f8b8", "acnet-f8b8-hdn", "acnet-f8b8-box", "acnet-f8b8-box-hdn",
    "acnet-f8b18", "acnet-f8b18-hdn", "acnet-f8b18-box", "acnet-f8b18-box-hdn",
    "arnet-f8b8", "arnet-f8b8-hdn", "arnet-f8b8-box", "arnet-f8b8-box-hdn",
    "arnet-f8b16", "arnet-f8b16-hdn", "arnet-f8b16-box", "arnet-f8b16-box-hdn",
    "arnet-f8b32", "arnet-f8b32-hdn", "arnet-f8b32-box", "arnet-f8b32-box-hdn",
    "arnet-f8b64", "arnet-f8b64-hdn", "arnet-f8b64-box", "arnet-f8b64-box-hdn",
    "artcnn-c4f16", "artcnn-c4f16-dn", "artcnn-c4f16-ds", "artcnn-c4f32", "artcnn-c4f32-dn", "artcnn-c4f32-ds",
    "fsrcnnx-f8b4", "fsrcnnx-f8b4-distort-plus", "fsrcnnx-f16b4", "fsrcnnx-f16b4-distort-plus",
)
INTERPOLATOR_VERSIONS = (
    "HD", "UHD", "anime", "v2", "v2.3", "v2.4", "v3.0", "v3.1", "v3.6", "v3.9", "v4", *(f"v4.{k}" for k in range(1, 27) if k != 16),
    "v4.12-lite", "v4.13-lite", "v4.14-lite", "v4.15-lite", "v4.16-lite", "v4.17-lite", "v4.22-lite", "v4.25-lite", "v4.25-heavy", "v4.26-large", "rife",
)
# The filters and the largest strength of grain.
DEBAND, DEBLOCK, MAX_GRAIN = "gradfun=1.5:8", "deblock=filter=weak:block=4:alpha=0.05:beta=0.05", 32


def quoted(text: Column) -> Column:
    """A text in single quotes, or in double ones if it holds a single quote only; null without quotes."""
    inner = F.when(text.contains("'") & text.contains('"'), F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))
    plain = F.concat(F.lit("'"), text, F.lit("'"))
    return F.coalesce(inner, F.when(text.contains("'"), F.concat(F.lit('"'), text, F.lit('"'))), plain, F.lit("null"))


def listed(values: Iterable[object]) -> str:
    """A list as the notes write it."""
    return "[" + ", ".join(repr(v) for v in sorted(values)) + "]"


def known(values: Iterable[str], model: Column) -> Column:
    return F.coalesce(model.isin(*values), F.lit(False))


def is_one_of(x: Column, values: Iterable[int]) -> Column:
    return F.coalesce(x.isin(*values), F.lit(False))


def sentence(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts))


def cugan_notes(model: Column, scale: Column, strength: Column) -> list[Column]:
    pro = F.coalesce(model == "models-pro", F.lit(False))
    of = lambda pairs: known([f"{a},{b}" for a, b in pairs], F.concat(scale.cast("string"), F.lit(","), strength.cast("string")))
    ships = F.when(pro, of(CUGAN_PRO)).otherwise(of(CUGAN_OTHER))
    missing = sentence(
        "Real-CUGAN ", model, " does not ship a (scale=", scale, ", denoise=", strength,
        ") checkpoint; the binary will silently fall back. Consider scale=2/3 with denoise=3 for cel anime.",
    )
    cascade = "Real-CUGAN pro lacks a native 4x checkpoint; the binary cascades 2x→2x. Real-ESRGAN x4 is usually preferable for 4x."
    return [F.when(~ships, missing), F.when(pro & (scale == 4), F.lit(cascade))]


def esrgan_notes(model: Column, scale: Column) -> list[Column]:
    listed_, name = known(ESRGAN_MODELS, model), sentence("Real-ESRGAN model ", quoted(model))
    stills = known([m for m, moving in ESRGAN_MODELS.items() if not moving], model)
    wasted = F.lit(ESRGAN_NATIVE**2) - scale * scale
    return [
        F.when(~listed_, sentence(name, " is not in our catalog; assuming x4 native scale.")),
        F.when(listed_ & (scale > ESRGAN_NATIVE), sentence(name, f" has native scale x{ESRGAN_NATIVE}; requested x", scale, " would extrapolate.")),
        F.when(
            listed_ & (scale < ESRGAN_NATIVE),
            sentence(
                name, f" runs at x{ESRGAN_NATIVE} natively; the binary will downscale the result to x", scale, ", which wastes ~", wasted,
                " GPU-frames worth of compute. Consider Real-CUGAN at native x", scale, ".",
            ),
        ),
        F.when(stills, sentence(name, " is a stills model and will flicker in motion. For anime episodes prefer realesr-animevideov3.")),
    ]


def waifu_notes(model: Column, scale: Column, strength: Column) -> list[Column]:
    listed_ = known(WAIFU_MODELS, model)
    notes = [F.when(~listed_, sentence("waifu2x model ", quoted(model), f" is not in our catalog; known models: {listed(WAIFU_MODELS)}"))]
    for name, (scales, _) in WAIFU_MODELS.items():
        advice = f" checkpoint (supported: {listed(scales)}). Pick scale=2 for cel anime, or scale=1 with models-cunet for denoise-only passes."
        notes.append(F.when((model == name) & ~is_one_of(scale, scales), sentence(f"waifu2x {name} does not ship a scale=", scale, advice)))
    advice = f" checkpoint (supported: {listed(WAIFU_STRENGTHS)}). Use -1 for no denoise; 3 is strongest."
    notes.append(F.when(listed_ & ~is_one_of(strength, WAIFU_STRENGTHS), sentence("waifu2x ", model, " does not ship a denoise=", strength, advice)))
    photo = known([m for m, (_, drawings) in WAIFU_MODELS.items() if not drawings], model)
    smooth = " is a photo model and will produce smoother, less line-faithful output on cel anime. For anime episodes prefer models-cunet."
    return [*notes, F.when(photo, sentence("waifu2x model ", quoted(model), smooth))]


def anime_notes(model: Column, scale: Column, strength: Column | None) -> list[Column]:
    unknown = sentence("Anime4K model ", quoted(model), f" is not in our catalog; see Anime4KCPP wiki Model list (default: {ANIME_DEFAULT})")
    notes = [
        F.when(~known(ANIME_MODELS, model), unknown),
        F.when(~is_one_of(scale, (1, 2, 3, 4)), F.lit("Anime4K scale should be within 1..4 for predictable output quality.")),
    ]
    if strength is not None:
        notes.append(F.when(~is_one_of(strength, WAIFU_STRENGTHS), F.lit("Anime4K denoise should stay in -1..3 to match preset compatibility.")))
    return notes


def model_notes(engine: Column, model: Column, scale: Column, strength: Column) -> Column:
    """What a user should know of a combination (P12): an array of texts, empty for good ones and for other engines."""
    by_engine = {
        CUGAN: cugan_notes(model, scale, strength),
        ESRGAN: esrgan_notes(model, scale),
        WAIFU: waifu_notes(model, scale, strength),
        ANIME: anime_notes(model, scale, None),
        ANIME_VS: anime_notes(model, scale, strength),
    }
    none = F.array().cast("array<string>")
    found = none
    for name, notes in by_engine.items():
        found = F.when(engine == name, F.array_compact(F.array(*(F.concat(F.lit(PREFIXES[name]), n) for n in notes)))).otherwise(found)
    return found


def interpolator_notes(version: Column) -> Column:
    """Notes on a version of the interpolator."""
    listed_ = known(INTERPOLATOR_VERSIONS, version)
    strange = sentence("rife: RIFE version ", quoted(version), " not in our catalog; behavior may differ.")
    lite = sentence(
        "rife: RIFE ", version,
        " is a lite variant — faster but lower quality. Prefer v4.22/v4.24-class non-lite models unless throughput is a hard constraint.",
    )
    return F.array_compact(F.array(F.when(~listed_, strange), F.when(listed_ & version.contains("-lite"), lite)))


def filter_chain(enabled: Column, deband: Column, deblock: Column, grain: Column) -> Column:
    """(vf, rationale, warnings) of the filters after upscaling (F29): bands, then blocks, then grain; ``vf`` is null if there are none.

    Null flags are off, and null grain is none; grain beyond the largest strength is lowered to it.
    """
    on = lambda x: F.coalesce(x, F.lit(False))
    grain = F.coalesce(grain, F.lit(0))
    strength = F.least(grain, F.lit(MAX_GRAIN))

    def chain(parts: Column) -> Column:
        none = F.size(parts) == 0
        idle = F.when(on(enabled), "postprocess enabled but all sub-filters off").otherwise("postprocess disabled")
        reasons = F.array_compact(
            F.array(
                F.when(on(deband), f"deband: {DEBAND} (smooths gradient banding)"),
                F.when(on(deblock), "deblock: weak filter, block=4 (cleans source compression artifacts)"),
                F.when(grain > 0, sentence("grain: noise c0s=", strength, " luma temporal+uniform (prevents over-smooth NVENC look)")),
            )
        )
        lowered = sentence("grain_addback ", grain, " clamped to ", strength, f" (valid range 0..{MAX_GRAIN})")
        return F.struct(
            F.when(~none, F.array_join(parts, ",")).alias("vf"),
            F.when(none, F.array(idle)).otherwise(reasons).alias("rationale"),
            F.array_compact(F.array(F.when(on(enabled) & (grain > MAX_GRAIN), lowered))).alias("warnings"),
        )

    parts = F.array(F.when(on(deband), DEBAND), F.when(on(deblock), DEBLOCK), F.when(grain > 0, sentence("noise=c0s=", strength, ":c0f=t+u")))
    return let(F.when(on(enabled), F.array_compact(parts)).otherwise(F.array().cast("array<string>")), chain)
