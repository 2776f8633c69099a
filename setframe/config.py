"""Dataset description: which columns feed the model, how rows are cut, how classes are ordered.

Everything here is plain driver-side metadata. No function in this module touches data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Class order, pad value, histogram range, split shares, working points.
CLASS_NAMES = ("fakes", "1p0n", "1p1n", "1pXn", "3p0n", "3pXn")
PAD_VALUE = -999.0
NORM_EPSILON = 1e-8
MATRIX_EPSILON = 1e-12
REWEIGHT_BINS = 500
REWEIGHT_RANGE = (15e3, 1e7)
CONTROL_BINS = 500
SCORE_BINS = 100
TRIM_SIGMA = 5.0
OUTLIER_LIMIT = 100.0
TEST_SPLIT = 0.2
VAL_SPLIT = 0.2
SPLIT_SEED = 42
BATCH_SIZE = 526
ROWS_PER_FILE = 100_000
ROWS_PER_FILE_BY_SOURCE = {"JZ4": 50_000}
WORKING_POINTS = (95, 75, 50, 40, 30, 20, 10)
BACKGROUND_PATTERN = "JZ"

N_CLASSES = len(CLASS_NAMES)


@dataclass(frozen=True)
class Collection:
    """One model input: either scalars (``max_objects == 1``) or a variable-length object list."""

    name: str
    features: tuple[str, ...]
    max_objects: int = 1

    @property
    def ragged(self) -> bool:
        return self.max_objects > 1

    @property
    def width(self) -> int:
        return len(self.features) * self.max_objects


@dataclass(frozen=True)
class Cuts:
    """Row cuts as boolean expressions. ``signal`` and ``background`` extend ``shared``."""

    shared: str
    signal_only: str | None = None
    background_only: str | None = None

    @property
    def signal(self) -> str:
        return _both(self.shared, self.signal_only)

    @property
    def background(self) -> str:
        return _both(self.shared, self.background_only)


@dataclass(frozen=True)
class DatasetConfig:
    collections: tuple[Collection, ...]
    passthrough: tuple[str, ...] = ()
    label: str = "label"
    weight: str = "weight"
    classes: tuple[str, ...] = CLASS_NAMES
    cuts: Cuts | None = None

    def input_columns(self) -> list[str]:
        """Every column a scan needs, once each, in first-seen order."""
        names = [f for c in self.collections for f in c.features]
        names += [*self.passthrough, self.label, self.weight]
        return list(dict.fromkeys(names))


def _both(first: str, second: str | None) -> str:
    return first if second is None else f"({first}) & ({second})"


_ABS_BELOW = re.compile(r"abs\(\s*(\w+)\s*\)\s*<\s*([0-9.]+(?:[eE][+-]?[0-9]+)?)")


def cut_to_sql(cut: str) -> str:
    """Write a numpy-style cut as a Spark SQL predicate.

    ``abs(x) < c`` becomes a two-sided range on the bare column, because only comparisons of a
    bare column with a literal are pushed into the Parquet reader.
    """
    ranged = _ABS_BELOW.sub(r"(\1 > -\2 AND \1 < \2)", cut)
    return ranged.replace("&", " AND ").replace("|", " OR ").replace("~", " NOT ")


# The default record layout (feature names, list caps, cuts, passthrough columns).
DEFAULT_COLLECTIONS = (
    Collection("TauTracks", (
        "TauTracks_nInnermostPixelHits_normed", "TauTracks_nPixelHits_normed",
        "TauTracks_nSCTHits_normed", "TauTracks_chargedScoreRNN_normed",
        "TauTracks_isolationScoreRNN_normed", "TauTracks_conversionScoreRNN_normed",
        "TauTracks_pt_normed", "TauTracks_dphiECal_normed", "TauTracks_detaECal_normed",
        "TauTracks_jetpt_normed", "TauTracks_d0TJVA_normed", "TauTracks_d0SigTJVA_normed",
        "TauTracks_z0sinthetaTJVA_normed", "TauTracks_z0sinthetaSigTJVA_normed"), 3),
    Collection("NeutralPFO", (
        "NeutralPFO_dphiECal_normed", "NeutralPFO_dphi_normed", "NeutralPFO_detaECal_normed",
        "NeutralPFO_deta_normed", "NeutralPFO_pt_normed", "NeutralPFO_jetpt_normed",
        "NeutralPFO_FIRST_ETA_normed", "NeutralPFO_SECOND_R_normed",
        "NeutralPFO_DELTA_THETA_normed", "NeutralPFO_CENTER_LAMBDA_normed",
        "NeutralPFO_LONGITUDINAL_normed", "NeutralPFO_SECOND_ENG_DENS_normed",
        "NeutralPFO_ENG_FRAC_CORE_normed", "NeutralPFO_NPosECells_EM1_normed",
        "NeutralPFO_NPosECells_EM2_normed", "NeutralPFO_energy_EM1_normed",
        "NeutralPFO_energy_EM2_normed", "NeutralPFO_EM1CoreFrac_normed",
        "NeutralPFO_firstEtaWRTClusterPosition_EM1_normed",
        "NeutralPFO_firstEtaWRTClusterPosition_EM2_normed",
        "NeutralPFO_secondEtaWRTClusterPosition_EM1_normed",
        "NeutralPFO_secondEtaWRTClusterPosition_EM2_normed"), 6),
    Collection("ShotPFO", (
        "ShotPFO_dphiECal_normed", "ShotPFO_dphi_normed", "ShotPFO_detaECal_normed",
        "ShotPFO_deta_normed", "ShotPFO_pt_normed", "ShotPFO_jetpt_normed"), 3),
    Collection("ConvTrack", (
        "ConvTrack_dphiECal_normed", "ConvTrack_dphi_normed", "ConvTrack_detaECal_normed",
        "ConvTrack_deta_normed", "ConvTrack_pt_normed", "ConvTrack_jetpt_normed",
        "ConvTrack_d0TJVA_normed", "ConvTrack_d0SigTJVA_normed",
        "ConvTrack_z0sinthetaTJVA_normed", "ConvTrack_z0sinthetaSigTJVA_normed"), 4),
    Collection("TauJets", (
        "TauJets_centFrac_normed", "TauJets_etOverPtLeadTrk_normed", "TauJets_dRmax_normed",
        "TauJets_SumPtTrkFrac_normed", "TauJets_ptRatioEflowApprox_normed",
        "TauJets_mEflowApprox_normed"), 1),
)
DEFAULT_PASSTHROUGH = (
    "TauJets_truthDecayMode", "TauJets_truthProng", "TauJets_mu", "TauJets_ptJetSeed",
    "TauJets_etaJetSeed", "TauJets_phiJetSeed", "TauJets_RNNJetScoreSigTrans",
    "TauJets_is1p0n", "TauJets_is1p1n", "TauJets_is1pxn", "TauJets_is3p0n", "TauJets_is3pxn",
    "TauJets_mcEventWeight",
)
DEFAULT_CUTS = Cuts(
    shared="(TauJets_ptJetSeed > 15000) & (abs(TauJets_etaJetSeed) < 2.5)",
    signal_only="(TauJets_IsTruthMatched) & (abs(TauJets_truthEtaVis) < 2.5)"
                " & (TauJets_truthPtVis > 15000)",
)
DEFAULT_DATASET = DatasetConfig(
    collections=DEFAULT_COLLECTIONS, passthrough=DEFAULT_PASSTHROUGH, cuts=DEFAULT_CUTS)
