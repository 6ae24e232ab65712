"""Formula-driven mixed-effects models on Spark tables.

Names are loaded when first used, so that a worker that needs one module loads no more.
"""

from __future__ import annotations

import importlib

_WHERE = {
    "plans.formula": ("FormulaError", "parse"),
    "plans.design": ("Design", "ModelError", "analyze"),
    "functions.families": ("FAMILIES", "LINKS"),
    "functions.curves": ("CURVES",),
    "operators.gram": ("Gram", "build_gram"),
    "operators.kernels.lmm": ("Singular",),
    "operators.model": ("ConfidenceIntervals", "FittedModel"),
    "operators.linear": ("PreparedLmer", "design_table", "fit_prepared", "lm", "lm_matrix", "lmer", "lmer_weighted", "prepare_lmer", "refit_lmer"),
    "operators.distributed": ("glmer_distributed", "lmer_distributed", "ranef_distributed"),
    "operators.generalized": ("PreparedGlmer", "fit_prepared_glmer", "glmer", "glmer_weighted", "glmer_with_link", "prepare_glmer"),
    "operators.nonlinear": ("nlmer", "nlmer_with_mean", "nlmer_with_options", "nls_by_key", "parse_nlmer"),
    "operators.inference": ("anova", "contrast_matrix", "contrast_matrix_from_names"),
    "operators.comparisons": ("adjust_p", "mcp_contrast_matrix"),
    "operators.timing": ("phase", "report"),
    "operators.resample": ("boot", "boot_glmer", "boot_lmer", "cv_grouped", "cv_grouped_glmer", "simulate"),
    "sources.tables": ("from_frame", "load_model", "read_table", "save_model"),
    "streaming.running": ("RunningModel", "score_stream"),
}
_AT = {name: module for module, names in _WHERE.items() for name in names}
__all__ = sorted(_AT)


def __getattr__(name: str):
    if name in _AT:
        return getattr(importlib.import_module(f"{__name__}.{_AT[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
