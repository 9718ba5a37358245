"""regmesh: fixed-effects regression and corpus preparation on PySpark.

Names are imported when first used, so that Python workers load only what they run.
"""

from importlib import import_module

_HOME = {
    "api": ("MultiModel", "feglm", "feols", "fepois"),
    "operators.absorb": ("Demeaner",),
    "operators.decompose": ("decompose",),
    "operators.did": ("SaturatedEventStudy", "did2s", "event_study", "lpdid", "panelview"),
    "operators.multiple": ("bonferroni", "rwolf", "wyoung"),
    "operators.ols": ("ssc",),
    "operators.quantreg": ("quantreg",),
    "operators.resample": ("ccv", "ritest", "wildboottest"),
    "operators.savi": ("savi",),
    "report": ("coefplot_frame", "etable", "iplot_frame", "qplot_frame", "summary"),
}
_WHERE = {name: module for module, names in _HOME.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
