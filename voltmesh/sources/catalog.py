"""Turbines, panels and CSP installations; own entries of published data, or YAML files of the same layout."""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Power curves (wind speed in m/s, power in MW) that the manufacturers published for these turbines, with the data sheet of each;
# in the compilation from which users know the names they are under CC-BY-4.0. Other turbines come from a folder of YAML files of the usual layout.
WINDTURBINES: dict[str, dict] = {
    "Bonus_B1000_1000kW": {
        "source": "http://cordis.europa.eu/documents/documentlibrary/47698371EN6.pdf",
        "hub_height": 48.0,
        "V": [3, 4, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 19, 25, 25],
        "POW": [0, 0, 0.024, 0.069, 0.133, 0.219, 0.333, 0.468, 0.598, 0.73, 0.85, 0.928, 0.973, 0.99, 0.997, 0.999, 1.0, 1.0, 0.0],
    },
    "Enercon_E101_3000kW": {
        "source": "http://www.enercon.de/p/downloads/EN_Productoverview_0710.pdf",
        "hub_height": 99.0,
        "V": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 28, 28],
        "POW": [0.0, 0.0, 0.003, 0.037, 0.118, 0.258, 0.479, 0.79, 1.2, 1.71, 2.34, 2.867, 3.034, 3.05, 3.05, 0.0],
    },
    "Enercon_E126_7500kW": {
        "source": "http://www.enercon.de/p/downloads/EN_Productoverview_0710.pdf",
        "hub_height": 135.0,
        "V": [0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 28, 28],
        "POW": [0.0, 0.0, 0.055, 0.175, 0.41, 0.76, 1.25, 1.9, 2.7, 3.75, 4.85, 5.75, 6.5, 7.0, 7.35, 7.5, 7.58, 7.58, 0.0],
    },
    "Enercon_E82_3000kW": {
        "source": "http://www.enercon.de/p/downloads/EN_Productoverview_0710.pdf",
        "hub_height": 85.0,
        "V": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 28, 28],
        "POW": [0.0, 0.0, 0.003, 0.025, 0.082, 0.174, 0.321, 0.532, 0.815, 1.18, 1.58, 1.9, 2.2, 2.48, 2.7, 2.85, 2.95, 3.02, 3.02, 0.0],
    },
    "NREL_ReferenceTurbine_5MW_offshore": {
        "source": "http://www.nrel.gov/docs/fy09osti/38060.pdf",
        "hub_height": 90.0,
        "V": [0, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 25, 25],
        "POW": [0.0, 0.0, 0.0405, 0.1777, 0.4039, 0.7376, 1.1872, 1.7711, 2.5186, 3.4484, 4.5625, 5.0, 5.0, 0.0],
    },
    "Siemens_SWT_107_3600kW": {
        "source": "http://www.energy.siemens.com/hq/pool/hq/power-generation/renewables/wind-power/wind%20turbines/E50001-W310-A103-V6-4A00_WS_SWT_3_6_107_US.pdf",
        "hub_height": 90.0,
        "V": [0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 25, 25],
        "POW": [0.0, 0.0, 0.0, 0.0, 0.0, 0.161, 0.351, 0.635, 1.026, 1.544, 2.204, 2.91, 3.399, 3.567, 3.596, 3.6, 3.6, 0.0],
    },
    "Siemens_SWT_2300kW": {
        "source": "http://www.energy.siemens.com/mx/pool/hq/power-generation/wind-power/E50001-W310-A102-V6-4A00_WS_SWT-2.3-93_US.pdf",
        "hub_height": 80.0,
        "V": [0, 4, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 25, 25],
        "POW": [0.0, 0.0, 0.098, 0.21, 0.376, 0.608, 0.914, 1.312, 1.784, 2.164, 2.284, 2.299, 2.3, 2.3, 0.0],
    },
    "Suzlon_S82_1.5_MW": {
        "source": "http://www.suzlon.com/pdf/S82%20product%20brochure.pdf",
        "hub_height": 79.0,
        "V": [0, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 20, 20],
        "POW": [0.0, 0.0, 0.01, 0.095, 0.23, 0.46, 0.725, 0.98, 1.2, 1.38, 1.45, 1.49, 1.5, 1.5, 0.0],
    },
    "Vestas_V112_3MW": {
        "source": "http://nozebra.ipapercms.dk/Vestas/Communication/Productbrochure/V11230MW/V11230MWOffshoreUK/",
        "hub_height": 80.0,
        "V": [0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 25, 25],
        "POW": [0.0, 0.0, 0.005, 0.15, 0.3, 0.525, 0.905, 1.375, 1.95, 2.58, 2.96, 3.05, 3.06, 3.06, 0.0],
    },
    "Vestas_V112_3MW_offshore": {
        "source": "http://nozebra.ipapercms.dk/Vestas/Communication/Productbrochure/V11230MW/V11230MWOffshoreUK/",
        "hub_height": 80.0,
        "V": [0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 25, 25],
        "POW": [0.0, 0.0, 0.005, 0.115, 0.3, 0.55, 0.945, 1.375, 1.96, 2.525, 2.95, 2.99, 3.0, 3.0, 0.0],
    },
    "Vestas_V164_7MW_offshore": {
        "source": "http://nozebra.ipapercms.dk/Vestas/Communication/Productbrochure/V16470MW/V16470MW/",
        "hub_height": 100.0,
        "V": [0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 25, 25],
        "POW": [0.0, 0.0, 0.005, 0.095, 0.46, 0.9, 1.6, 2.5, 3.725, 5.0, 6.0, 6.7, 6.98, 7.0, 7.0, 0.0],
    },
    "Vestas_V25_200kW": {
        "source": "http://www.kulak.com.pl/Wiatraki/pdf/vestas%20v25.pdf",
        "hub_height": 29.0,
        "V": [3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 14, 25, 25],
        "POW": [0, 0.0036, 0.0123, 0.0244, 0.0399, 0.0634, 0.0902, 0.1189, 0.1457, 0.1712, 0.1951, 0.2001, 0.2, 0.2, 0],
    },
    "Vestas_V47_660kW": {
        "source": "http://www.iufmrese.cict.fr/concours/2002/CG_2002STI_lycee/Pour_en_savoir_plus/Vestas_V47.pdf",
        "hub_height": 45.0,
        "V": [3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 25, 25],
        "POW": [0, 0.0029, 0.0438, 0.0967, 0.166, 0.252, 0.35, 0.45, 0.538, 0.6, 0.635, 0.651, 0.657, 0.659, 0.66, 0.66, 0.66, 0],
    },
    "Vestas_V80_2MW_gridstreamer": {
        "source": "http://nozebra.ipapercms.dk/Vestas/Communication/Productbrochure/2MWGridStreamer/2MWGridStreamerUK/",
        "hub_height": 80.0,
        "V": [0, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 25, 25],
        "POW": [0.0, 0.0, 0.0, 0.0, 0.025, 0.075, 0.25, 0.425, 0.65, 0.925, 1.2, 1.5, 1.825, 1.95, 1.975, 2.0, 2.0, 0.0],
    },
    "Vestas_V90_3MW": {
        "source": "http://nozebra.ipapercms.dk/Vestas/Communication/Productbrochure/V9030MW/V9030MWUK/",
        "hub_height": 80.0,
        "V": [0, 2, 4, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 25, 25],
        "POW": [0.0, 0.0, 0.0, 0.065, 0.195, 0.34, 0.57, 0.88, 1.27, 1.71, 2.14, 2.54, 2.83, 2.995, 3.0, 3.0, 0.0],
    },
}
# Huld (2010) and Bofinger coefficients of the published panels.
SOLARPANELS: dict[str, dict] = {
    "CSi": {"model": "huld", "efficiency": 0.1, "c_temp_amb": 1, "c_temp_irrad": 0.035, "r_tamb": 293, "r_tmod": 298, "r_irradiance": 1000, "k_1": -0.017162, "k_2": -0.040289, "k_3": -0.004681, "k_4": 0.000148, "k_5": 0.000169, "k_6": 0.000005, "inverter_efficiency": 0.9},
    "CdTe": {"model": "huld", "efficiency": 0.1, "c_temp_amb": 1, "c_temp_irrad": 0.035, "r_tamb": 293, "r_tmod": 298, "r_irradiance": 1000, "k_1": -0.103251, "k_2": -0.040446, "k_3": -0.001667, "k_4": -0.002075, "k_5": -0.001445, "k_6": -0.000023, "inverter_efficiency": 0.9},
    "KANENA": {"model": "bofinger", "A": 0.0659164166836276, "B": -4.44310393547042e-06, "C": 0.0122044905275824, "D": -0.0035, "NOCT": 318, "Tstd": 298, "Tamb": 293, "Intc": 800, "ta": 0.9, "threshold": 1, "inverter_efficiency": 0.9},
}
CSPINSTALLATIONS: dict[str, dict] = {
    "lossless_installation": {"technology": None, "r_irradiance": 1000.0, "altitude": [0.0, 90.0], "azimuth": [0.0, 360.0], "efficiency": [[1.0, 1.0], [1.0, 1.0]]},
}


def _yaml(path: str | Path) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text())


def _found(name: str | Path, known: dict[str, dict], folder: str | Path | None) -> dict | None:
    """The entry of a name, or of a YAML file: a path, or ``name`` in ``folder``, which wins; None if there is neither."""
    if folder is not None:
        for file in (Path(folder) / f"{name}.yaml", Path(folder) / f"{name}.yml", Path(folder) / str(name)):
            if file.is_file():
                return _yaml(file)
    if str(name) in known:
        return dict(known[str(name)])
    return _yaml(name) if str(name).endswith((".yaml", ".yml")) else None


def validate_turbine(turbine: dict, add_cutout_windspeed: bool = True) -> dict:
    """POW, V, P, hub_height are there, POW and V fit and V does not fall; optionally ends with no power at the largest V."""
    if missing := {"POW", "V", "P", "hub_height"} - set(turbine):
        raise ValueError(f"the turbine lacks {sorted(missing)}")
    v, p = [float(x) for x in turbine["V"]], [float(x) for x in turbine["POW"]]
    if len(v) != len(p):
        raise ValueError("V and POW differ in length")
    if any(b < a for a, b in zip(v, v[1:], strict=False)):
        raise ValueError("V must not fall")
    top = max(v)
    if add_cutout_windspeed and not any(x == top and y == 0 for x, y in zip(v, p, strict=True)):
        v, p = [*v, top], [*p, 0.0]
    return turbine | {"V": v, "POW": p, "P": float(turbine["P"]), "hub_height": float(turbine["hub_height"])}


def windturbine(turbine: str | Path | dict, add_cutout_windspeed: bool = True, folder: str | Path | None = None, library: DataFrame | None = None) -> dict:
    """By name, by YAML file (HUB_HEIGHT, V, POW; a path, or a name in ``folder``), a dict, or ``oedb:`` and the type of the one turbine
    of a public ``library`` (see ``filter_turbine_library``) that holds this text."""
    if isinstance(turbine, dict):
        return validate_turbine({"P": max(turbine.get("POW", [0]))} | turbine, add_cutout_windspeed)
    if str(turbine).startswith("oedb:"):
        if library is None:
            raise ValueError("a turbine of the public library needs its table: library=")
        rows = filter_turbine_library(library, turbine_type=str(turbine).removeprefix("oedb:")).limit(2).collect()
        if len(rows) != 1:
            raise KeyError(f"{turbine!r} fits {'several turbines' if rows else 'no turbine'} of the library")
        return validate_turbine({"name": rows[0]["turbine_type"], "V": rows[0]["V"], "POW": rows[0]["POW"], "P": rows[0]["P"], "hub_height": rows[0]["hub_height_m"]}, add_cutout_windspeed)
    found = _found(turbine, WINDTURBINES, folder)
    if found is None:
        raise KeyError(f"no turbine {turbine!r}; known: {sorted(WINDTURBINES)}, and YAML files in a folder")
    found["hub_height"] = found.pop("HUB_HEIGHT", found.get("hub_height"))
    return validate_turbine(found | {"P": max(found["POW"])}, add_cutout_windspeed)


def solarpanel(panel: str | Path | dict, folder: str | Path | None = None) -> dict:
    if isinstance(panel, dict):
        return panel
    found = _found(panel, SOLARPANELS, folder)
    if found is None:
        raise KeyError(f"no panel {panel!r}; known: {sorted(SOLARPANELS)}, and YAML files in a folder")
    return found


def cspinstallation(installation: str | Path | dict, folder: str | Path | None = None) -> dict:
    """By name, dict, or YAML file whose efficiency is columns of altitude, azimuth (degrees) and value (percent). The tables of
    simulated towers and troughs (1,387 values each) are read from such files and not kept here."""
    if isinstance(installation, dict):
        return installation
    raw = _found(installation, CSPINSTALLATIONS, folder)
    if raw is None:
        raise KeyError(f"no installation {installation!r}; known: {sorted(CSPINSTALLATIONS)}, and YAML files in a folder")
    if "altitude" in raw:
        return raw
    eff = raw["efficiency"]
    rows = {(float(a), float(z)): float(v) / 100 for a, z, v in zip(eff["altitude"].values(), eff["azimuth"].values(), eff["value"].values(), strict=True)}
    alt, az = sorted({a for a, _ in rows}), sorted({z for _, z in rows})
    technology = None if raw.get("technology") in (None, "None") else raw["technology"]
    return {"technology": technology, "r_irradiance": float(raw["r_irradiance"]), "altitude": alt, "azimuth": az, "efficiency": [[rows[a, z] for z in az] for a in alt]}


def rated_capacity(config: dict) -> float:
    """Of a turbine in MW, of a panel in kW per m2."""
    if "POW" in config:
        return float(config["P"])
    if config.get("model", "huld") == "huld":
        return float(config["efficiency"])
    return (config["A"] + 1000 * config["B"] + config["C"] * math.log(1000)) * 1e3


def turbine_table(spark) -> DataFrame:
    rows = [(k, t["hub_height"], t["P"], t["V"], t["POW"]) for k in WINDTURBINES for t in [windturbine(k)]]
    return spark.createDataFrame(rows, "name string, hub_height double, P double, V array<double>, POW array<double>")


def filter_turbine_library(library: DataFrame, **search: str) -> DataFrame:
    """Rows of a public turbine library that have a power curve and hold each searched text, whatever its case.

    Columns: has_power_curve, power_curve_wind_speeds and power_curve_values (JSON lists, kW), hub_height ("a; b").
    Adds V, POW (MW), P and hub_height_m (the truncated mean of the heights listed, 100 without any).
    """
    cond: Column = F.col("has_power_curve")
    for name, text in search.items():
        cond = cond & F.lower(F.col(name)).contains(str(text).lower())
    heights = F.filter(F.transform(F.split("hub_height", ";"), lambda x: F.try_to_number(F.trim(x), F.lit("99999.99")).cast("double")), lambda x: x.isNotNull())
    mean = F.aggregate(heights, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(heights), F.lit(0))
    return library.where(cond).withColumns(
        {
            "V": F.from_json("power_curve_wind_speeds", "array<double>"),
            "POW": F.transform(F.from_json("power_curve_values", "array<double>"), lambda x: x / F.lit(1000.0)),
            "hub_height_m": F.coalesce(F.floor(mean).cast("double"), F.lit(100.0)),
        }
    ).withColumn("P", F.array_max("POW"))
