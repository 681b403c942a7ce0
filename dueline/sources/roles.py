"""Column roles of well-known public logs."""

from __future__ import annotations

from dueline.spec import EventLogSpec

# Roles of the columns of the BPI Challenge 2018 log (payment
# applications), the BPI Challenge 2019 log (purchase orders) and an invoice
# log.
PAYMENT_APPLICATIONS = EventLogSpec(
    numeric=(
        "case:penalty_amount0", "case:penalty_amount1", "case:penalty_amount2",
        "case:penalty_amount3", "month", "weekday", "hour", "time_since_first_event",
        "time_since_last_event", "case:amount_applied0", "case:amount_applied1",
        "case:amount_applied2", "case:amount_applied3", "case:number_parcels", "case:area",
        "case:payment_actual0", "case:payment_actual1", "case:payment_actual2",
        "case:payment_actual3",
    ),
    dynamic=("org:resource", "concept:name", "success", "subprocess", "note"),
    static=(
        "case:young farmer", "case:penalty_AJLP", "case:small farmer", "case:penalty_BGP",
        "case:department", "case:penalty_C16", "case:penalty_BGK", "case:penalty_AVUVP",
        "case:penalty_CC", "case:penalty_AVJLP", "case:penalty_C9", "case:cross_compliance",
        "case:rejected", "case:penalty_C4", "case:penalty_AVGP", "case:penalty_ABP",
        "case:penalty_B6", "case:penalty_B4", "case:penalty_B5", "case:penalty_AVBP",
        "case:penalty_B2", "case:selected_risk", "case:penalty_B3", "case:selected_manually",
        "case:penalty_AGP", "case:penalty_B16", "case:penalty_GP1", "case:basic payment",
        "case:penalty_B5F", "case:penalty_V5", "case:redistribution", "case:penalty_JLP6",
        "case:penalty_JLP7", "case:penalty_JLP5", "case:penalty_JLP2", "case:penalty_JLP3",
        "case:penalty_JLP1",
    ),
)
PURCHASE_ORDERS = EventLogSpec(
    numeric=(
        "Cumulative net worth (EUR)", "year", "month", "weekday", "hour",
        "time_since_first_event", "time_since_last_event",
    ),
    dynamic=("org:resource", "concept:name"),
    static=(
        "case:Spend area text", "case:Company", "case:Document Type",
        "case:Sub spend area text", "case:Item Type", "case:Item Category",
        "case:Spend classification text", "case:GR-Based Inv. Verif.", "case:Goods Receipt",
    ),
)
PURCHASE_ORDER_STATES = (
    "Create Purchase Order Item", "Record Goods Receipt", "Record Invoice Receipt",
    "Clear Invoice",
)
INVOICES = EventLogSpec(
    case="CaseID",
    activity="Activity",
    timestamp="Timestamp",
    resource="Resource",
    deadline="payment_run",
    numeric=(
        "Invoice Amount", "Payment Term", "time_since_first_event", "time_since_last_event",
    ),
    dynamic=("Activity", "Resource"),
    static=("Vendor",),
)
