"""Settings of one feature and model run, passed as arguments instead of process environment."""

from __future__ import annotations

from dataclasses import dataclass

# The z-score cut for outlier states and the smallest normal double used by the shifted log.
Z_CUT = 1.645
LOG_EPS = 2.2250738585072014e-308

# The regularisation strengths tried by cross-validation.
REG_PARAMS = (0.0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


@dataclass(frozen=True)
class Config:
    """All knobs of profiling, encoding and modelling.

    `log_shifts` are further shifts of the log, tried beside `log_eps`: each column keeps the one whose W in train is largest.
    """

    category_trunc_threshold: float = 0.01
    unbalanced_threshold: float = 10.0
    z_cut: float = Z_CUT
    log_eps: float = LOG_EPS
    log_shifts: tuple[float, ...] = ()
    inline_rare: int = 1_000
    category_convert: bool = False
    cat_transform: bool = False
    scale_data: bool = False
    keep_raw_categories: bool = False
    fit_on: str = "train"
    handle_invalid: str = "error"
    model: str = "lr"
    nfolds: int = 10
    split_fraction: float = 0.75
    num_splits: int = 5
    seed: int = 1
    parallelism: int = 4
    partitions: int | None = None
    rows_per_partition: int | None = None
    reg_params: tuple[float, ...] = REG_PARAMS
    svm_reg_param: float = 0.01
    svm_tol: float = 1e-6
    gbt_depth: int = 5
    gbt_learn_rate: float = 0.1
    gbt_max_iter: int = 20

    def run_name(self) -> str:
        """Name of the run in the champion record: model and settings joined by underscores."""
        parts = [
            self.model,
            float(self.split_fraction),
            float(self.nfolds),
            self.category_convert,
            self.cat_transform,
            self.scale_data,
            float(self.unbalanced_threshold),
            float(self.category_trunc_threshold),
        ]
        if self.model == "gbt":
            parts += [float(self.gbt_depth), float(self.gbt_learn_rate)]
        return "_".join(str(p) for p in parts)
