"""Registered queries and the SQL that checks them."""

from weftline.plans.algebra import algebra
from weftline.plans.chains import chains
from weftline.plans.evidence import evidence
from weftline.plans.interchange import interchange
from weftline.plans.records import records
from weftline.plans.relational import relational
from weftline.plans.scalar import scalar

CORE = [relational, algebra, scalar, records, interchange, chains, evidence]
