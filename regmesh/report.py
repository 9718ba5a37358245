"""Tables and plot frames of fitted models: etable, summary, coefficient, event and quantile frames."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd

from .operators.model import LinearModel


def _models(models) -> list[LinearModel]:
    if isinstance(models, LinearModel):
        return [models]
    return models.to_list() if hasattr(models, "to_list") else list(models)


def select_coefs(names: list[str], keep: list[str] | str | None = None, drop: list[str] | str | None = None, exact_match: bool = False) -> list[str]:
    """Names matching the keep patterns, in their order, without those matching the drop patterns."""
    as_list = lambda v: [v] if isinstance(v, str) else list(v or [])
    hit = (lambda p, n: p == n) if exact_match else (lambda p, n: re.search(p, n) is not None)
    out = list(dict.fromkeys(n for p in as_list(keep) for n in names if hit(p, n))) if keep else list(names)
    return [n for n in out if not any(hit(p, n) for p in as_list(drop))]


def relabel(name: str, labels: dict[str, str] | None, template: str = "{variable}::{value}") -> str:
    """A coefficient's name with the labels of its variables."""
    labels = labels or {}
    if name in labels:
        return labels[name]
    parts = []
    for part in name.split(":") if "::" not in name else re.split(r"(?<!:):(?!:)", name):
        m = re.fullmatch(r"(?:C\((\w+)\)|(\w+))\[T?\.?(.+)\]", part) or re.fullmatch(r"()(\w[\w.]*)::(.+)", part)
        if m:
            variable = m[1] or m[2]
            parts.append(template.format(variable=labels.get(variable, variable), value=m[3], value_int=re.sub(r"\.0$", "", m[3])))
        else:
            parts.append(labels.get(part, part))
    return " x ".join(parts) if len(parts) > 1 else parts[0]


def _stars(p: float, code: list[float] | None) -> str:
    if not code or p != p:
        return ""
    return "*" * sum(p < c for c in code)


def etable(
    models, type: str = "df", signif_code: list[float] | None = (0.001, 0.01, 0.05), coef_fmt: str = "b (se)", digits: int = 3, keep=None, drop=None, exact_match: bool = False, labels: dict[str, str] | None = None,
    show_fe: bool = True, custom_stats: dict[str, list] | None = None, custom_model_stats: dict[str, list] | None = None, model_heads: list[str] | None = None, head_order: str = "dh", file_name: str | None = None, notes: str = "",
) -> pd.DataFrame | str:
    """A regression table of models as a frame, markdown, html, LaTeX or typst; written to file_name where given.

    coef_fmt may use b (estimate with stars), se, t, p, ci_l, ci_u and the names of custom_stats (a list a model of lists).
    """
    ms = _models(models)
    code = list(signif_code) if signif_code else []
    if any(a >= b for a, b in zip(code, code[1:], strict=False)):
        raise ValueError("signif_code must rise")
    all_names = list(dict.fromkeys(n for m in ms for n in m.coefnames))
    names = select_coefs(all_names, keep, drop, exact_match)
    heads = [f"({i + 1})" for i in range(len(ms))]
    body: dict[str, list[str]] = {}
    tables = [m.tidy() for m in ms]
    num = lambda v: f"{v:.{digits}f}"
    for n in names:
        cells = []
        for i, (m, t) in enumerate(zip(ms, tables, strict=True)):
            if n not in t.index:
                cells.append("")
                continue
            r = t.loc[n].iloc[:6].tolist()
            values = {"b": num(r[0]) + _stars(r[3], code), "se": num(r[1]), "t": num(r[2]), "p": num(r[3]), "ci_l": num(r[4]), "ci_u": num(r[5])}
            for k, v in (custom_stats or {}).items():
                values[k] = num(v[i][m.coefnames.index(n)])
            cells.append(re.sub(r"\b(" + "|".join(sorted(map(re.escape, values), key=len, reverse=True)) + r")\b", lambda x, v=values: v[x[1]], coef_fmt))
        body[relabel(n, labels)] = cells
    foot: dict[str, list[str]] = {}
    if show_fe:
        for f in dict.fromkeys(f for m in ms for f in m.design.fe):
            foot[relabel(f, labels)] = ["x" if f in m.design.fe else "-" for m in ms]
    for k, v in (custom_model_stats or {}).items():
        foot[k] = [str(x) for x in v]
    foot["Observations"] = [f"{int(m.n)}" for m in ms]
    foot["S.E. type"] = ["by: " + "+".join(m.clusters) if isinstance(m.vcov_type, dict) else str(m.vcov_type) for m in ms]
    if all(m.method == "feols" for m in ms):
        foot["R2"] = [num(m.r2) for m in ms]
        foot["R2 Within"] = [num(m.r2_within) if m.design.fe else "-" for m in ms]
    top = {"depvar": [relabel(m.formula.depvar, labels) for m in ms]}
    if model_heads:
        top["head"] = list(model_heads)
    out = pd.DataFrame({**top, **body, **foot}, index=heads).T
    note = notes or (f"Significance levels: {', '.join('*' * (len(code) - i) + f' p < {c}' for i, c in enumerate(code))}. Format of coefficient cell: {coef_fmt}" if code else f"Format of coefficient cell: {coef_fmt}")
    text = {"df": None, "md": _markdown, "html": _html, "tex": _latex, "typst": _typst}
    if type not in text:
        raise ValueError(f"type is one of {sorted(text)}")
    if type == "df":
        return out
    made = text[type](out, note, len(top), len(body))
    if file_name:
        with open(file_name, "w") as f:
            f.write(made)
    return made


def _markdown(t: pd.DataFrame, note: str, top: int, body: int) -> str:
    rows = [["", *t.columns], *[[i, *r] for i, r in zip(t.index, t.to_numpy().tolist(), strict=True)]]
    wide = [max(len(str(r[c])) for r in rows) for c in range(len(rows[0]))]
    line = lambda r: "| " + " | ".join(str(v).ljust(w) for v, w in zip(r, wide, strict=True)) + " |"
    return "\n".join([line(rows[0]), "|" + "|".join("-" * (w + 2) for w in wide) + "|", *map(line, rows[1:]), "", note])


def _html(t: pd.DataFrame, note: str, top: int, body: int) -> str:
    cell = lambda tag, v: f"<{tag}>{html.escape(str(v))}</{tag}>"
    rows = ["<tr>" + cell("th", i) + "".join(cell("td", v) for v in r) + "</tr>" for i, r in zip(t.index, t.to_numpy().tolist(), strict=True)]
    return "<table><thead><tr>" + "".join(cell("th", c) for c in ["", *t.columns]) + "</tr></thead><tbody>" + "".join(rows) + f"</tbody><caption>{html.escape(note)}</caption></table>"


def _latex(t: pd.DataFrame, note: str, top: int, body: int) -> str:
    safe = lambda v: re.sub(r"([&%$#_{}])", r"\\\1", str(v))
    lines = [r"\begin{tabular}{l" + "c" * t.shape[1] + "}", r"\toprule", " & ".join(["", *map(safe, t.columns)]) + r" \\"]
    for k, (i, r) in enumerate(zip(t.index, t.to_numpy().tolist(), strict=True)):
        if k in (top, top + body):
            lines.append(r"\midrule")
        lines.append(" & ".join([safe(i), *map(safe, r)]) + r" \\")
    return "\n".join([*lines, r"\bottomrule", r"\end{tabular}", f"% {note}"])


def _typst(t: pd.DataFrame, note: str, top: int, body: int) -> str:
    cell = lambda v: "[" + re.sub(r"([*_#$\[\]])", r"\\\1", str(v)) + "]"
    rows = [", ".join(map(cell, ["", *t.columns])), *[", ".join(map(cell, [i, *r])) for i, r in zip(t.index, t.to_numpy().tolist(), strict=True)]]
    return f"#table(columns: {t.shape[1] + 1},\n  " + ",\n  ".join(rows) + f"\n)\n// {note}"


def summary(models, digits: int = 3, out: Callable[[str], None] = print) -> None:
    """Prints each model: formula, sample, covariance, coefficients and fit."""
    for m in _models(models):
        out("###\n")
        out(f"Estimation:  {m.method}{' IV' if m.is_iv else ''}\nDep. var.: {m.formula.depvar}, Fixed effects: {m.formula.fe_name}\nInference:  {m.vcov_type}\nObservations:  {int(m.n)}\n")
        out(m.tidy().round(digits).to_string())
        if m.method == "feols":
            out(f"---\nRMSE: {m.rmse:.{digits}f} R2: {m.r2:.{digits}f}" + (f" R2 Within: {m.r2_within:.{digits}f}" if m.design.fe else ""))
        elif hasattr(m, "deviance"):
            out(f"---\nDeviance: {m.deviance:.{digits}f}")


def coefplot_frame(models, alpha: float = 0.05, keep=None, drop=None, exact_match: bool = False, labels=None, joint: bool = False, seed: int | None = None) -> pd.DataFrame:
    """model, Coefficient, Estimate and interval (joint ones beside, on demand): what a coefficient plot shows."""
    out = []
    for i, m in enumerate(_models(models)):
        t = m.tidy(alpha)
        ci = m.confint(alpha)
        frame = pd.DataFrame({"model": f"({i + 1})", "fml": m.formula.text, "Coefficient": t.index, "Estimate": t["Estimate"].to_numpy(), "ci_low": ci.iloc[:, 0].to_numpy(), "ci_high": ci.iloc[:, 1].to_numpy()})
        if joint:
            both = m.confint(alpha, joint=True, seed=seed)
            frame["joint_low"], frame["joint_high"] = both.iloc[:, 0].to_numpy(), both.iloc[:, 1].to_numpy()
        order = {n: k for k, n in enumerate(select_coefs(list(t.index), keep, drop, exact_match))}
        frame = frame[frame["Coefficient"].isin(list(order))].assign(order=lambda d, o=order: d["Coefficient"].map(o)).sort_values("order").drop(columns="order")
        out.append(frame)
    made = pd.concat(out, ignore_index=True)
    made["label"] = [relabel(n, labels) for n in made["Coefficient"]]
    return made


def iplot_frame(models, alpha: float = 0.05, **kwargs) -> pd.DataFrame:
    """The coefficients of i() terms with variable and level apart: what an event plot shows."""
    t = coefplot_frame(models, alpha, **kwargs)
    t = t[t["Coefficient"].str.contains("::", regex=False)].copy()
    parts = t["Coefficient"].str.extract(r"^([^:]+)::([^:]+)")
    t["variable"], t["level"] = parts[0], parts[1]
    t["at"] = pd.to_numeric(t["level"], errors="coerce")
    return t.sort_values(["model", "at"], ignore_index=True)


def qplot_frame(models: dict, alpha: float = 0.05) -> pd.DataFrame:
    """quantile by coefficient with intervals: what a quantile-process plot shows."""
    from .operators.quantreg import process_frame

    return process_frame(models, alpha)


def decomposition_frame(decomposition) -> pd.DataFrame:
    """Start and end of each bar of a waterfall from the direct to the unexplained effect."""
    t = decomposition.tidy()["coefficients"]
    rows, at = [("direct_effect", 0.0, t["direct_effect"])], t["direct_effect"]
    for name in t.index[4:]:
        rows.append((name, at, at - t[name]))
        at -= t[name]
    return pd.DataFrame([*rows, ("unexplained_effect", 0.0, t["unexplained_effect"])], columns=["part", "start", "end"])
