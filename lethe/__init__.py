"""lethe: privacy-compliance (right-to-erasure) analytics on Spark.

Entry points by task:

* discovery        ``lethe.plans.discovery.discover_subjects``
* submissions      ``lethe.plans.requests.submit_requests``
* processing       ``lethe.plans.requests.process_plan``, ``lethe.plans.erasure.plan_erasure``
* verification     ``lethe.plans.erasure.verify_counts`` / ``verify_deletion``
* processors       ``lethe.plans.requests.coordinate_processors``
* subject status   ``lethe.plans.requests.subject_status``
* end to end       ``lethe.plans.scenario.full_scenario``
* views / masks    ``lethe.plans.views``, ``lethe.functions.masking``, ``lethe.operators.policies``
* reports          ``lethe.plans.reports``
* kept state       ``lethe.sources.state.StateFolder``
* streaming        ``lethe.streaming.operators``
"""

__version__ = "0.1.0"
