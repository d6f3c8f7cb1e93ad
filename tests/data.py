"""Small graphs of known measures, and numbers that the models must hit (fixed values)."""

import numpy as np
import pandas as pd

V3 = pd.DataFrame([["ING", "NL", 1e12], ["ABN", "NL", 5e11], ["BNP", "FR", 13e12]], columns=["name", "country", "assets"])
E3 = pd.DataFrame([["ING", "ABN", 1e6], ["BNP", "ABN", 1.7e5], ["ABN", "BNP", 1e4], ["BNP", "ING", 3e3]], columns=["creditor", "debtor", "value"])
V4 = pd.DataFrame([["ING", "NL"], ["ABN", "NL"], ["BNP", "FR"], ["BNP", "IT"]], columns=["name", "country"])
COLUMNS = ["creditor", "c_country", "debtor", "d_country", "value"]
E4 = pd.DataFrame(
    [["ING", "NL", "ABN", "NL", 1e6], ["BNP", "FR", "ABN", "NL", 2.3e7], ["BNP", "IT", "ABN", "NL", 7.03e5], ["ABN", "NL", "BNP", "FR", 1e4], ["ABN", "NL", "ING", "NL", 4e5]],
    columns=COLUMNS,
)
EM = pd.DataFrame(
    [
        ["ING", "NL", "ABN", "NL", 1e6, "interbank", False],
        ["BNP", "FR", "ABN", "NL", 2.3e7, "external", False],
        ["BNP", "IT", "ABN", "NL", 7e5, "interbank", True],
        ["BNP", "IT", "ABN", "NL", 3e3, "interbank", False],
        ["ABN", "NL", "BNP", "FR", 1e4, "interbank", False],
        ["ABN", "NL", "ING", "NL", 4e5, "external", True],
    ],
    columns=[*COLUMNS, "type", "EUR"],
)
V5 = pd.DataFrame([["ING", "NL"], ["ABN", "NL"], ["BNP", "FR"], ["BNP", "IT"], ["ING", "IT"]], columns=["name", "country"])
E5 = pd.DataFrame(
    [
        ["ING", "NL", "ABN", "NL", 1e6],
        ["BNP", "FR", "ABN", "NL", 2.3e7],
        ["BNP", "FR", "ING", "IT", 3.7e6],
        ["ING", "IT", "ING", "NL", 7e5],
        ["BNP", "IT", "ABN", "NL", 7.03e5],
        ["ABN", "NL", "BNP", "FR", 1e4],
        ["ABN", "NL", "ING", "NL", 4e5],
    ],
    columns=COLUMNS,
)
KEYS = {"v_id": ["name", "country"], "src": ["creditor", "c_country"], "dst": ["debtor", "d_country"], "weight": "value"}

OUT4, IN4 = np.array([4.1e5, 2.3e7, 7.03e5, 1e6]), np.array([2.4703e7, 1e4, 0, 4e5])
ADJ4 = np.array([[0, 1, 0, 1], [1, 0, 0, 0], [1, 0, 0, 0], [1, 0, 0, 0]])
OUTM = np.array([[0, 4e5, 1e4, 0], [2.3e7, 0, 0, 0], [0, 0, 3e3, 7e5], [0, 0, 1e6, 0]])
INM = np.array([[2.3e7, 0, 1.003e6, 7e5], [0, 0, 1e4, 0], [0, 0, 0, 0], [0, 4e5, 0, 0]])
OUT5, IN5 = np.array([4.1e5, 2.67e7, 7.03e5, 7e5, 1e6]), np.array([2.4703e7, 1e4, 0, 3.7e6, 1.1e6])
GROUPS5 = np.array([2, 0, 1, 1, 2])

#: (kind, self-loops): z that gives five links.
Z4 = {("fitness", False): 4.291803e-12, ("fitness", True): 5.27016837e-13, ("invariant", False): 2.91360376e-12, ("invariant", True): 2.28804213e-13}
ZM = {("fitness", False): 8.98906315567293e-10, ("fitness", True): 1.1263141e-10, ("invariant", False): 3.19467039e-10, ("invariant", True): 6.83321635e-11}
ZL = {"fitness": [2.02975770e-06, 6.71088639e-03, 1.82652908e-09, 2.19130984e-03], "invariant": [3.96975425e-14, 1.3125e-10, 7.74951582e-10, 4.28571428e-11]}
Z5 = {False: 1.240346e-13, True: 6.623465e-14}
