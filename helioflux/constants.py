"""Numbers and tables that are part of the semantics: fixed values."""

C_KM_S = 299792.458
AU_KM = 1.495978707e8
L1_R_AU = (AU_KM - 1.5e6) / AU_KM
CLASS_FLOORS = {"A": 1e-8, "B": 1e-7, "C": 1e-6, "M": 1e-5, "X": 1e-4}
LADDER = "ABCMX"
SATURATION_CPS = 1e5
GRID_DT_S, FEATURE_DT_S, MAX_INTERP_CADENCES = 1.0, 60.0, 3
CUSUM_K, CUSUM_H = 0.5, 5.0
K_ON, K_OFF, M_OF, N_OF = 5.0, 2.0, 3, 4
POISSON_RATIO, POISSON_H, FOCUS_THRESHOLD = 1.8, 5.0, 10.0
HAMPEL_K, HAMPEL_WIDTH = 3.0, 7
RISE_SAMPLES, RISE_RATIO = 4, 1.4
EMA_ALPHA, GATE_CHI2, DECAY_TAU_S = 0.99, 10.8, 240.0
LEAD_S, LAG_S, MATCH_TAU, GUARD_S, BUCKET_S = 300.0, 900.0, 0.5, 90.0, 3600.0
CONFIRM, REJECT, PEAK_TOL_S, LOCATION_TOL_DEG = 0.7, 0.3, 180.0, 10.0
EMBARGO_MIN, HISTORY_TAU_S, LEAD_WINDOW_S, K_OF_M, LEAD_BUCKETS_MIN = 120.0, 21600.0, 7200.0, (2, 3), (5, 10, 15, 30)
CYCLE_REF_S, CYCLE_S = 1577836800.0, 11.0 * 365.25 * 86400.0
FLUX_FLOOR, CAP_MIN, RING = 1e-12, 1440.0, 30

QC_BITS = {"GOOD": 1, "INTERPOLATED": 2, "FILLED": 4, "SUSPECT": 8, "BAD": 16, "NEAR_SAA": 32, "SATURATED": 64, "DATA_GAP": 128, "SPIKE_REJECTED": 256}
QC_TOKENS = {
    "good": "GOOD", "interpolated": "INTERPOLATED", "interp": "INTERPOLATED", "filled": "FILLED", "suspect": "SUSPECT",
    "bad": "BAD", "near_saa": "NEAR_SAA", "saa": "NEAR_SAA", "saturated": "SATURATED", "saturation": "SATURATED",
    "data_gap": "DATA_GAP", "gap": "DATA_GAP", "spike_rejected": "SPIKE_REJECTED", "spike": "SPIKE_REJECTED",
}

PLATFORM_R_AU = {"ADITYA-L1": L1_R_AU, "L1": L1_R_AU, "EARTH": 1.0, "GOES": 1.0, "STEREO-A": 0.96, "SOLAR ORBITER": 0.50, "SOLO": 0.50, "PARKER": 0.046, "PSP": 0.046}
CANONICAL_UNITS = {"SXR_LONG": "W m^-2", "SXR_SHORT": "W m^-2", "HXR": "counts/s", "EUV": "W m^-2", "RADIO": "sfu", "PROTON": "pfu", "MAGSCALAR": "1"}
_SXR = {"w m^-2": 1.0, "w/m^2": 1.0, "w m-2": 1.0, "w m^2": 1.0, "watt/m^2": 1.0, "mw m^-2": 1e-3, "uw m^-2": 1e-6, "erg s^-1 cm^-2": 1e-3, "erg/s/cm^2": 1e-3}
UNIT_FACTORS = {
    "SXR_LONG": _SXR,
    "SXR_SHORT": _SXR,
    "HXR": {"counts/s": 1.0, "counts s^-1": 1.0, "count/s": 1.0, "cps": 1.0, "cts/s": 1.0, "kcps": 1e3, "counts/min": 1.0 / 60.0},
    "EUV": {"w m^-2": 1.0, "w/m^2": 1.0, "mw m^-2": 1e-3, "uw m^-2": 1e-6},
    "RADIO": {"sfu": 1.0, "solar flux unit": 1.0, "jy": 1e-4},
    "PROTON": {"pfu": 1.0, "particles cm^-2 s^-1 sr^-1": 1.0, "cm^-2 s^-1 sr^-1": 1.0},
}
HXR_COEFFS = {"STIX": (0.0, 1.0, 0.0), "HEL1OS": (0.0, 1.0, 0.10), "GBM": (0.0, 1.0, 0.08), "KONUS": (0.0, 1.0, 0.12)}
FILL_RESID = {"SXR_LONG": 0.06, "SXR_SHORT": 0.06, "HXR": 0.10, "EUV": 0.08}

#: source_id, quantity, reliability, cadence_s, latency_budget_s, typical_sigma, platform, band, vantage_r_au
SOURCES = [
    ("ADITYA_SOLEXS", "SXR_LONG", 0.90, 1.0, 86400.0, 5e-8, "Aditya-L1", "1-8A", 0.990),
    ("GOES_PRIMARY_XRSB", "SXR_LONG", 0.98, 1.0, 180.0, 2e-8, "GOES-19", "1-8A", 1.0),
    ("CHANDRAYAAN2_XSM", "SXR_LONG", 0.85, 1.0, 86400.0, 6e-8, "Chandrayaan-2", "1-15keV", 1.0),
    ("GOES_PRIMARY_XRSA", "SXR_SHORT", 0.96, 1.0, 180.0, 2e-9, "GOES-19", "0.5-4A", 1.0),
    ("ADITYA_SOLEXS_SHORT", "SXR_SHORT", 0.88, 1.0, 86400.0, 5e-9, "Aditya-L1", "0.5-4A", 0.990),
    ("ADITYA_HEL1OS", "HXR", 0.85, 1.0, 86400.0, 20.0, "Aditya-L1", "8-30keV", 0.990),
    ("SOLO_STIX_25-50keV", "HXR", 0.95, 1.0, 3600.0, 15.0, "Solar Orbiter", "25-50keV", 0.50),
    ("FERMI_GBM", "HXR", 0.90, 1.0, 3600.0, 25.0, "Fermi", "8-40000keV", 1.0),
    ("KONUS_WIND", "HXR", 0.88, 3.0, 86400.0, 30.0, "Wind", "20-1500keV", 1.0),
    ("SDO_EVE", "EUV", 0.90, 10.0, 86400.0, 1e-5, "SDO", "6-106nm", 1.0),
    ("STEREOA_EUVI", "EUV", 0.80, 180.0, 86400.0, 2e-5, "STEREO-A", "17.1-30.4nm", 0.96),
    ("WIND_WAVES", "RADIO", 0.75, 1.0, 86400.0, 10.0, "Wind", "4kHz-14MHz", 1.0),
    ("ECALLISTO", "RADIO", 0.65, 0.25, 86400.0, 15.0, "e-CALLISTO", "45-870MHz", 1.0),
    ("GOES_SEISS", "PROTON", 0.92, 60.0, 180.0, 0.1, "GOES-19", ">10MeV", 1.0),
    ("ACE_EPAM", "PROTON", 0.85, 60.0, 86400.0, 0.2, "ACE", "0.05-5MeV", 1.0),
]
