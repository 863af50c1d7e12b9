"""Fixed values of the data formats: names, units, required keys. They must equal what solver files and case files hold."""

# Solver variable -> field name.
FIELD_NAMES = {"temp": "temperature", "pres": "pressure", "mflx": "massflux", "nrmx": "normx", "nrmy": "normy", "fv_x": "velfacex", "fv_y": "velfacey"}
# Fields on x faces and y faces.
X_FACE, Y_FACE = "velfacex", "velfacey"
# Fields that change sign when the domain is reflected along an axis.
NEGATED_BY_X_FLIP = ("velx", "normx", "velfacex", "omgm")
NEGATED_BY_Y_FLIP = ("vely", "normy", "velfacey", "omgm")
# Solver runtime parameter -> non-dimensional parameter.
NON_DIMENSIONAL = {
    "ins_gravx": "gravx",
    "ins_gravy": "gravy",
    "ins_gravz": "gravz",
    "ins_invreynolds": "inv_reynolds",
    "ins_inflowvelscale": "inflow_velscale",
    "ht_prandtl": "prandtl",
    "mph_stefan": "stefan",
    "mph_tsat": "tsat",
    "mph_invweber": "inv_weber",
    "mph_cpgas": "cpgas",
    "mph_mugas": "mugas",
    "mph_rhogas": "rhogas",
    "mph_thcogas": "thcogas",
}
# Scalars of a heater file; wallTemp is kept as wall_temp_fraction.
HEATER_SCALARS = ("xMin", "xMax", "yMin", "yMax", "zMin", "zMax", "wallTemp", "advAngle", "rcdAngle", "velContact", "nucWaitTime")
HEATER_SHARED_KEYS = ("type", "xMin", "xMax", "yMin", "yMax", "zMin", "zMax", "advAngle", "rcdAngle", "velContact", "nucWaitTime")
WALL_TEMP, HEAT_FLUX = "constant_wall_temp", "constant_heat_flux"
# Side -> solver parameter with its boundary type.
BOUNDARY_KEYS = {"left": "xl_boundary_type", "right": "xr_boundary_type", "bottom": "yl_boundary_type", "top": "yr_boundary_type"}
# Units of dimensional parameters.
PHYSICAL_UNITS = {
    "bulk_temp": "degC",
    "sat_temp": "degC",
    "wall_temp_scale": "degC",
    "length_scale": "m",
    "velocity_scale": "m/s",
    "time_scale": "s",
    "rho_liquid": "kg/m^3",
    "thco_liquid": "W/(m K)",
}
HEATER_UNITS = {"wall_temp": "degC", "heat_flux": "W/m^2"}
REQUIRED_DISCRETIZATION = ("num_blocks_x", "num_blocks_y", "nx_block", "ny_block", "x_min", "x_max", "y_min", "y_max", "dt", "t_initial")
EXPECTED_PHYSICAL = ("wall_temp_scale", "bulk_temp", "sat_temp", "length_scale", "velocity_scale", "time_scale", "rho_liquid", "thco_liquid")
MUST_BE_POSITIVE = {"physical": ("length_scale", "velocity_scale", "time_scale", "rho_liquid"), "non_dimensional": ("inv_reynolds", "prandtl", "cpgas", "mugas", "rhogas")}
CONFIG_GROUPS = ("physical", "non_dimensional", "discretization", "heaters", "boundary")
GRAVITY = ("gravx", "gravy", "gravz")
# Names of plot files, heater files and the heater count in flash.par.
PLOTFILE_PATTERN, HEATER_PATTERN = r"_hdf5_plt_cnt_\d+$", r"_hdf5_htr_\d+$"
HEATER_COUNT_PATTERN = r"(?im)^\s*htr_numHeaters\s*=\s*(\d+)"
SPLITS = ("train", "val", "test")
